"""Prepared programs, results, and transactions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.lower import Lowering, Output, q
from trailweave.plans.errors import GraphError, Unsupported, WrongResultKind
from trailweave.plans.parser import parse
from trailweave.plans.tree import Program, RowQuery, Union
from trailweave.sources.graph import Graph


def id_text(value: Column) -> Column:
    """A node id as 16 characters: 96 bits, the most significant first, in the alphabet of
    URL-safe base64."""
    return F.translate(F.base64(F.unhex(F.lpad(F.hex(value), 24, "0"))), "+/", "-_")


class Result:
    """Rows of a query, or the number of elements that a mutation touched."""

    def __init__(self, df: DataFrame | None, rows_affected: int | None = None):
        self._df, self._affected = df, rows_affected

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise WrongResultKind("a mutation has no rows")
        return self._df

    @property
    def rows_affected(self) -> int:
        if self._affected is None:
            raise WrongResultKind("a row query has no count")
        return self._affected

    def cursor(self) -> Iterator:
        """Rows one at a time, a partition in memory at most."""
        return self.df.toLocalIterator()

    def collect(self) -> list:
        return self.df.collect()

    def to_json(self) -> str:
        """An array of objects, or {"ok": true, "rows_affected": n}."""
        if self._df is None:
            return json.dumps({"ok": True, "rows_affected": self._affected})
        names = self._df.columns
        return json.dumps([{n: _plain(r[i]) for i, n in enumerate(names)} for r in self.cursor()])

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


def _plain(value):
    if hasattr(value, "asDict"):
        if set(value.asDict()) == {"t", "s", "i", "f", "b"}:
            return {1: value["s"], 2: value["i"], 3: value["f"], 7: value["b"]}.get(value["t"])
        out = {k: _plain(v) for k, v in value.asDict().items()}
        if isinstance(out.get("properties"), str):
            out["properties"] = json.loads(out["properties"])
        return out
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def rendered(graph: Graph, df: DataFrame, outputs: list[Output], expand: bool = True) -> DataFrame:
    """Named columns; a node or edge variable as {id, labels, properties} (an edge also with
    start, end, directed). Repeated names get a number."""
    used: dict[str, int] = {}
    columns = []
    for o in outputs:
        used[o.name] = used.get(o.name, 0) + 1
        alias = o.name if used[o.name] == 1 else f"{o.name}_{used[o.name]}"
        if o.binding.kind not in ("node", "edge"):
            columns.append(F.col(q(o.column)).alias(alias))
            continue
        if not expand:
            columns.append((id_text(F.col(q(o.column))) if o.binding.kind == "node" else F.col(q(o.column))).alias(alias))
            continue
        key, made = f"{o.column}_key", f"{o.column}_whole"
        if o.binding.kind == "node":
            table, props = graph.nodes(o.binding.label, None, labels=True), graph.node_props(o.binding.label)
            fields = [id_text(F.col("id")).alias("id"), F.col("labels")]
        else:
            table, props = graph.edges(o.binding.label, None, labels=True), graph.edge_props(o.binding.label)
            fields = [F.col("eid").alias("id"), "labels", id_text(F.col("src")).alias("start"), id_text(F.col("dst")).alias("end"), "directed"]
        own = [_json_value(F.col(q(k)), kind).alias(k) for k, kind in props.items() if k in table.columns]
        whole = F.struct(*fields, (F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("properties"))
        side = table.select(F.col("id" if o.binding.kind == "node" else "eid").alias(key), whole.alias(made))
        df = df.join(side, F.col(q(o.column)) == F.col(q(key)), "left").drop(key)
        columns.append(F.col(q(made)).alias(alias))
    return df.select(*columns)


def _json_value(c: Column, kind: str) -> Column:
    return F.coalesce(c["s"], c["i"].cast("string"), c["f"].cast("string"), c["b"].cast("string")) if kind == "mixed" else c


class Prepared:
    """A parsed program. All statements are lowered before any runs where it only reads."""

    def __init__(self, session: Session, program: Program):
        self.session, self.program = session, program

    def execute(self, params: dict | None = None) -> Result:
        return self.session._execute(self.program, params)


class Session:
    """Queries over a typed graph, or over a store with transactions.

    Without ``begin`` every program is a transaction of its own; its statements run in order
    and the result is the last one's.
    """

    def __init__(self, source):
        self.source, self.open = source, None

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse(text))

    def execute(self, text: str, params: dict | None = None) -> Result:
        return self.prepare(text).execute(params)

    def begin(self) -> None:
        if self.open is not None:
            raise GraphError("a transaction is open")
        self.open = self._writable().begin()

    def commit(self) -> None:
        if self.open is None:
            raise GraphError("no transaction is open")
        transaction, self.open = self.open, None
        transaction.commit()

    def rollback(self) -> None:
        if self.open is None:
            raise GraphError("no transaction is open")
        self.open = None

    def _writable(self):
        if isinstance(self.source, Graph):
            raise Unsupported("this graph is read only")
        return self.source

    def _execute(self, program: Program, params: dict | None) -> Result:
        if not program.statements:
            return Result(None, 0)
        if isinstance(self.source, Graph):
            for statement in program.statements:
                result = run_read(self.source, statement, params)
            return result
        transaction = self.open or self.source.begin()
        for statement in program.statements:
            result = run_read(transaction.graph(), statement, params) if isinstance(statement, (RowQuery, Union)) else Result(None, transaction.mutate(statement, params))
        if self.open is None:
            transaction.commit()
        return result


def run_read(graph: Graph, statement, params: dict | None) -> Result:
    from trailweave.plans.tree import Finish

    lowering = Lowering(graph, params, statement)
    if isinstance(statement, RowQuery):
        return Result(rendered(graph, *lowering.row_query(statement)))
    if isinstance(statement, Union):
        return Result(rendered(graph, *lowering.union(statement)))
    if isinstance(statement, Finish):
        return Result(None, lowering.match(lowering.clauses(()), statement.match).df.count())
    raise Unsupported("this graph is read only")


def query(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    """The rows of one query over a typed graph."""
    return Session(graph).execute(text, params).df
