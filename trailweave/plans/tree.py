"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    key: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Index:
    base: object
    place: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object  # None: all rows
    distinct: bool = False


@dataclass(frozen=True)
class NodeP:
    var: str | None = None
    label: str | None = None
    props: tuple = ()


@dataclass(frozen=True)
class EdgeP:
    direction: str
    var: str | None = None
    label: str | None = None
    props: tuple = ()
    bounds: tuple[int, int] | None = None


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodeP, ...]
    edges: tuple[EdgeP, ...]
    trail: bool = False


@dataclass(frozen=True)
class Where:
    expr: object = None
    path: Path | None = None
    negated: bool = False


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: Where | None = None
    optional: bool = False


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class With:
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Return:
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[tuple[object, bool], ...] = ()  # (expression, descending)
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class RowQuery:
    clauses: tuple
    ret: Return


@dataclass(frozen=True)
class Union:
    parts: tuple[RowQuery, ...]
    alls: tuple[bool, ...]  # for each part but the first


@dataclass(frozen=True)
class Insert:
    match: Match | None
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetItem:
    var: str
    key: str | None = None
    value: object = None
    label: str | None = None


@dataclass(frozen=True)
class Change:
    """SET or REMOVE after a MATCH."""

    match: Match
    items: tuple[SetItem, ...]
    remove: bool = False


@dataclass(frozen=True)
class Delete:
    match: Match
    vars: tuple[str, ...]
    detach: bool = False


@dataclass(frozen=True)
class Finish:
    match: Match


@dataclass(frozen=True)
class Program:
    statements: tuple = field(default_factory=tuple)


def walk(expr):
    """The expression and all below it."""
    yield expr
    for name in ("base", "place", "inner", "left", "right", "arg"):
        below = getattr(expr, name, None)
        if below is not None and not isinstance(below, (str, int)):
            yield from walk(below)


def has_aggregate(expr) -> bool:
    return any(isinstance(x, Agg) for x in walk(expr))


def names(expr) -> set[str]:
    """Variables that an expression reads."""
    return {x.name if isinstance(x, Var) else x.var for x in walk(expr) if isinstance(x, (Var, Prop))}
