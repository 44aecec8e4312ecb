"""Clauses to DataFrames.

A pattern variable is its id column until a property is needed; the properties that a
statement reads are known beforehand and joined once, or read from the edge table itself
where it holds them. Correlated parts (optional matches, pattern predicates) are evaluated
over the distinct values of the outer variables they use and joined back null-safely, so no
row numbers are needed and Catalyst picks the joins.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import expressions as X
from trailweave.functions.expressions import Value
from trailweave.plans.errors import MissingParameter, UnknownIdentifier, Unsupported, WrongType
from trailweave.plans.tree import Agg, Bin, EdgeP, Index, Lit, Match, NodeP, Not, Param, Path, Prop, Return, RowQuery, Union, Var, Where, With, has_aggregate, names, walk
from trailweave.sources.graph import Graph, oriented

REVERSED = {"left": "right", "right": "left", "undirected": "undirected", "left_or_undirected": "right_or_undirected", "right_or_undirected": "left_or_undirected", "left_or_right": "left_or_right", "any": "any"}


@dataclass
class Binding:
    """What a name stands for: its column, kind ("node", "edge", or that of a scalar), the
    label that is certain, and the columns of the properties that are at hand."""

    column: str
    kind: str
    label: str | None = None
    item: str | None = None
    props: dict[str, tuple[str, str]] = field(default_factory=dict)  # key -> (column, kind)
    loaded: bool = False  # all properties that the statement needs are at hand
    nullable: bool = False

    @property
    def columns(self) -> list[str]:
        return [self.column, *(c for c, _ in self.props.values())]


@dataclass
class Rows:
    """Binding rows: a DataFrame (None: one row without columns) and its scope."""

    df: DataFrame | None
    scope: dict[str, Binding]


@dataclass
class Output:
    name: str
    column: str
    binding: Binding


class Lowering:
    """Of one statement over one graph, with parameter values."""

    def __init__(self, graph: Graph, params: dict | None, statement):
        self.graph, self.params, self.fresh = graph, params or {}, itertools.count()
        self.needed: dict[str, set[str]] = {}
        self._collect(statement)

    # Which properties are read

    def _collect(self, node) -> None:
        if isinstance(node, Prop):
            self.needed.setdefault(node.var, set()).add(node.key)
        if hasattr(node, "__dataclass_fields__"):
            for name in node.__dataclass_fields__:
                self._collect(getattr(node, name))
        elif isinstance(node, (tuple, list)):
            for x in node:
                self._collect(x)

    def name(self, hint: str) -> str:
        return f"{re.sub(r'[^A-Za-z0-9_]', '_', hint)}_{next(self.fresh)}"

    # Expressions

    def value(self, expr, scope: dict[str, Binding]) -> Value:
        if isinstance(expr, Lit):
            return X.literal(expr.value)
        if isinstance(expr, Param):
            if expr.name not in self.params:
                raise MissingParameter(f"${expr.name} has no value")
            return X.literal(self.params[expr.name])
        if isinstance(expr, Var):
            b = self.bound(expr.name, scope)
            return Value(F.col(b.column), b.kind, label=b.label, item=b.item)
        if isinstance(expr, Prop):
            b = self.bound(expr.var, scope)
            if b.kind not in ("node", "edge", "null"):
                raise WrongType(f"{expr.var} is no node or edge")
            if expr.key in b.props:
                column, kind = b.props[expr.key]
                return Value(F.col(column), kind)
            return Value(F.lit(None), "null")
        if isinstance(expr, Index):
            return X.index(self.value(expr.base, scope), self.value(expr.place, scope))
        if isinstance(expr, Not):
            return Value(~X.truthy(self.value(expr.inner, scope)), "bool")
        if isinstance(expr, Bin):
            return X.binary(expr.op, self.value(expr.left, scope), self.value(expr.right, scope))
        if isinstance(expr, Agg):
            raise Unsupported("an aggregate can't stand here")
        raise Unsupported(type(expr).__name__)

    def constant(self, expr) -> bool:
        """Whether an expression is a value that isn't null or NaN."""
        value = None if expr is None else expr.value if isinstance(expr, Lit) else self.params.get(expr.name) if isinstance(expr, Param) else None
        return value is not None and value == value

    def predicate(self, expr, scope: dict[str, Binding]) -> Column:
        """An expression whose rows are dropped where it is false or null. Comparisons stay as
        they are, so that scans can evaluate them."""
        if not isinstance(expr, Bin):
            return X.truthy(self.value(expr, scope))
        if expr.op in ("AND", "OR"):
            left, right = self.predicate(expr.left, scope), self.predicate(expr.right, scope)
            return left & right if expr.op == "AND" else left | right
        a, b = self.value(expr.left, scope), self.value(expr.right, scope)
        plain = a.kind in X.NUMBERS and b.kind in X.NUMBERS or a.kind == b.kind == "string"
        if expr.op == "=":
            return self.equality(expr.left, a, expr.right, b)
        if expr.op in ("<", "<=", ">", ">=") and plain:
            found = X.compare(expr.op, a.column, b.column)
            # Spark takes NaN for the greatest number: it must not win on the greater side.
            side, value = (expr.left, a) if expr.op in (">", ">=") else (expr.right, b)
            return found if value.kind != "float" or self.constant(side) else found & ~F.isnan(value.column)
        return X.truthy(self.value(expr, scope))

    def equality(self, left, a: Value, right, b: Value) -> Column:
        """Equality in a filter: with a constant, null can't be meant."""
        if (self.constant(left) or self.constant(right)) and (a.kind == b.kind != "mixed" or a.kind in X.NUMBERS and b.kind in X.NUMBERS):
            return a.column == b.column
        return X.equal(a, b)

    def bound(self, name: str, scope: dict[str, Binding]) -> Binding:
        if name not in scope:
            raise UnknownIdentifier(name)
        return scope[name]

    # Rows

    def start(self, rows: Rows) -> DataFrame:
        return rows.df if rows.df is not None else self.graph.spark.range(1).select(F.lit(1).alias("one__"))

    def load(self, rows: Rows, var: str) -> Rows:
        """Join the properties that the statement reads of a node or edge variable."""
        b = rows.scope[var]
        wanted = self.needed.get(var, set()) - set(b.props)
        if b.loaded or b.kind not in ("node", "edge"):
            return rows
        kinds = self.graph.node_props(b.label) if b.kind == "node" else self.graph.edge_props(b.label)
        keys = sorted(wanted & set(kinds))
        if not keys:
            return Rows(rows.df, {**rows.scope, var: replace(b, loaded=True)})
        table = self.graph.nodes(b.label, set(keys)) if b.kind == "node" else self.graph.edges(b.label, set(keys))
        key = self.name("k")
        made = {k: (self.name(f"{var}.{k}"), kinds[k]) for k in keys}
        side = table.select(F.col("id" if b.kind == "node" else "eid").alias(key), *(F.col(k).alias(made[k][0]) for k in keys))
        df = rows.df.join(side, F.col(q(b.column)) == F.col(q(key)), "left" if b.nullable else "inner").drop(key)
        return Rows(df, {**rows.scope, var: replace(b, props={**b.props, **made}, loaded=True)})

    def with_label(self, rows: Rows, var: str, label: str | None) -> Rows:
        """Keep rows whose node or edge has the label."""
        b = rows.scope[var]
        if label is None or b.label == label:
            return rows
        if b.label is not None and self.graph.one_label:
            return Rows(rows.df.where(F.lit(False)), rows.scope)
        key = self.name("k")
        table = self.graph.nodes(label, set()) if b.kind == "node" else self.graph.edges(label, set())
        side = table.select(F.col("id" if b.kind == "node" else "eid").alias(key))
        df = rows.df.join(side, F.col(q(b.column)) == F.col(q(key)), "left_semi")
        return Rows(df, {**rows.scope, var: replace(b, label=label)})

    def with_props(self, rows: Rows, var: str, props: tuple) -> Rows:
        """Keep rows whose properties equal the values, null equal to null."""
        if not props:
            return rows
        for key, _ in props:
            self.needed.setdefault(var, set()).add(key)
        b = rows.scope[var]
        if any(k not in b.props for k, _ in props):
            rows = self.load(Rows(rows.df, {**rows.scope, var: replace(b, loaded=False)}), var)
        for key, expr in props:
            rows = self.load_all(rows, names(expr))
            rows = Rows(rows.df.where(self.equality(None, self.value(Prop(var, key), rows.scope), expr, self.value(expr, rows.scope))), rows.scope)
        return rows

    def load_all(self, rows: Rows, wanted: set[str]) -> Rows:
        for var in sorted(wanted & set(rows.scope)):
            rows = self.load(rows, var)
        return rows

    # Patterns

    def check_kind(self, scope: dict[str, Binding], var: str | None, kind: str) -> None:
        if var is not None and var in scope and scope[var].kind not in (kind, "null"):
            raise WrongType(f"{var} is no {kind}")

    def node_vars(self, path: Path) -> list[str]:
        return [n.var or self.name("_n") for n in path.nodes]

    def path(self, rows: Rows, path: Path) -> Rows:
        vars_ = self.node_vars(path)
        for node in path.nodes:
            self.check_kind(rows.scope, node.var, "node")
        for edge in path.edges:
            if edge.bounds is None:
                self.check_kind(rows.scope, edge.var, "edge")
            elif edge.var is not None and edge.var in rows.scope:
                raise Unsupported(f"{edge.var} is bound already")
        anchor = next((i for i, v in enumerate(vars_) if v in rows.scope), None)
        if anchor is None:
            # Predicates that read other variables of the path need its order; otherwise the
            # first node with a predicate, which is likely to be selective.
            read = {n for part in (*path.nodes, *path.edges) for _, e in part.props for n in names(e)}
            anchor = next((i for i, n in enumerate(path.nodes) if n.props), 0) if read <= set(rows.scope) else 0
            rows = self.anchor(rows, path, vars_, anchor)
        else:
            rows = self.seen_node(rows, vars_[anchor], path.nodes[anchor])
        seeded = rows.scope[vars_[anchor]].column == ""
        steps = [(i, i + 1, i, False) for i in range(anchor, len(path.edges))] + [(i + 1, i, i, True) for i in range(anchor - 1, -1, -1)]
        for near, far, i, backwards in steps:
            rows = self.step(rows, vars_[near], path.edges[i], vars_[far], path.nodes[far], path.trail, backwards)
            if seeded:
                rows, seeded = self.with_props(rows, vars_[anchor], path.nodes[anchor].props), False
        return rows

    def seen_node(self, rows: Rows, var: str, node: NodeP) -> Rows:
        return self.with_props(self.with_label(rows, var, node.label), var, node.props)

    def implied(self, edge: EdgeP, backwards: bool) -> tuple[str | None, str | None]:
        """Labels that the near and the far node of a step are sure to have."""
        direction = REVERSED[edge.direction] if backwards else edge.direction
        src, dst = self.graph.ends(edge.label)
        if direction == "right":
            return src, dst
        if direction == "left":
            return dst, src
        return (src, dst) if src == dst else (None, None)

    def anchor(self, rows: Rows, path: Path, vars_: list[str], at: int) -> Rows:
        """The first node of an unbound path: a scan of its label, or, where the next edge's
        table already says all about it, that table itself."""
        var, node = vars_[at], path.nodes[at]
        wanted = self.needed.setdefault(var, set()) | {k for k, _ in node.props}
        self.needed[var] = wanted
        follow = (at, False) if at < len(path.edges) else (at - 1, True) if at > 0 else None
        if follow is not None and (edge := path.edges[follow[0]]).bounds is None and (edge.var is None or edge.var not in rows.scope):
            near, _ = self.implied(edge, follow[1])
            direction = REVERSED[edge.direction] if follow[1] else edge.direction
            end = {"right": "src", "left": "dst"}.get(direction)
            kinds = self.graph.node_props(near) if near else {}
            own = self.graph.inline(edge.label).get(end, {}) if end else {}
            if near is not None and (node.label in (None, near)) and (wanted & set(kinds)) <= set(own):
                # The step binds it: an adjacency whose near end is the anchor.
                return self.seed(rows, var, near)
        table = self.graph.nodes(node.label, wanted)
        kinds = self.graph.node_props(node.label)
        column = self.name(var)
        made = {k: (self.name(f"{var}.{k}"), kinds[k]) for k in sorted(wanted & set(kinds))}
        side = table.select(F.col("id").alias(column), *(F.col(q(k)).alias(c) for k, (c, _) in made.items()))
        binding = Binding(column, "node", node.label, props=made, loaded=True)
        return self.combine(rows, side, {var: binding}, var, node.props)

    def seed(self, rows: Rows, var: str, label: str) -> Rows:
        return Rows(rows.df, {**rows.scope, var: Binding("", "node", label, loaded=False)})

    def combine(self, rows: Rows, side: DataFrame, bindings: dict[str, Binding], var: str, props: tuple) -> Rows:
        """Rows with each row of an unconnected table: an equi-join where properties are
        predicated by what is bound, a product otherwise."""
        scope = {**rows.scope, **bindings}
        if rows.df is None:
            joined = Rows(side, scope)
            for key, expr in props:
                joined = Rows(joined.df.where(self.equality(None, self.value(Prop(var, key), scope), expr, self.value(expr, scope))), scope)
            return joined
        condition = None
        for _, expr in props:
            rows = self.load_all(rows, names(expr))
        scope = {**rows.scope, **bindings}
        for key, expr in props:
            one = self.equality(None, self.value(Prop(var, key), scope), expr, self.value(expr, scope))
            condition = one if condition is None else condition & one
        return Rows(rows.df.join(side, F.lit(True) if condition is None else condition, "inner"), scope)

    def step(self, rows: Rows, x: str, edge: EdgeP, y: str, node: NodeP, trail: bool, backwards: bool) -> Rows:
        if edge.bounds is not None:
            return self.repeat(rows, x, edge, y, node, trail, backwards)
        direction = REVERSED[edge.direction] if backwards else edge.direction
        reused = edge.var is not None and edge.var in rows.scope
        evar = edge.var if edge.var is not None and not reused else self.name("_e")
        if reused:  # a second use of an edge variable is an equality
            self.needed[evar] = set()
        ekeys = {k for k, _ in edge.props} | self.needed.get(evar, set())
        kinds = self.graph.edge_props(edge.label)
        adj = oriented(self.graph, edge.label, direction, ekeys)
        if self.graph.derived(edge.label) and set(rows.scope) == {x} and rows.df is not None:
            # Known ends go below the aggregation that makes the edges.
            ends = self.name("k")
            adj = adj.join(rows.df.select(F.col(q(rows.scope[x].column)).alias(ends)), F.col("u") == F.col(q(ends)), "left_semi")
        u, v, eid = self.name(x), self.name(y), self.name(evar)
        eprops = {k: (self.name(f"{evar}.{k}"), kinds[k]) for k in sorted(ekeys & set(kinds))}
        near, far = self.implied(edge, backwards)
        seed = rows.scope[x].column == ""
        y_bound, loop = y in rows.scope and y != x, y == x
        nprops: dict[str, dict[str, tuple[str, str]]] = {"u": {}, "v": {}}
        for side, var, label, use in (("u", x, near, seed), ("v", y, far, not y_bound and not loop)):
            wanted = self.needed.setdefault(var, set()) | ({k for k, _ in node.props} if var == y else set())
            self.needed[var] = wanted
            if use and label is not None:
                found = self.graph.node_props(label)
                nprops[side] = {k: (self.name(f"{var}.{k}"), found[k]) for k in sorted(wanted & set(found)) if f"{side}.{k}" in adj.columns}
        adj = adj.select(
            F.col("u").alias(u), F.col("v").alias(v), F.col("eid").alias(eid),
            *(F.col(q(k)).alias(c) for k, (c, _) in eprops.items()),
            *(F.col(q(f"{s}.{k}")).alias(c) for s in ("u", "v") for k, (c, _) in nprops[s].items()),
        )
        if loop:
            adj = adj.where(F.col(q(u)) == F.col(q(v)))
        scope = dict(rows.scope)
        if seed:
            wanted = self.needed.get(x, set())
            complete = (wanted & set(self.graph.node_props(near))) <= set(nprops["u"])
            scope[x] = Binding(u, "node", near, props=nprops["u"], loaded=complete)
            ebind = Binding(eid, "edge", edge.label, props=eprops, loaded=True)
            if y_bound:
                joined = rows.df.join(adj, F.col(q(rows.scope[y].column)) == F.col(q(v)), "inner")
            else:
                joined = adj if rows.df is None else rows.df.join(adj, F.lit(True), "inner")
        else:
            condition = F.col(q(scope[x].column)) == F.col(q(u))
            if y_bound:
                condition &= F.col(q(scope[y].column)) == F.col(q(v))
            joined = rows.df.join(adj, condition, "inner").drop(u)
            ebind = Binding(eid, "edge", edge.label, props=eprops, loaded=True)
        if reused:
            joined = joined.where(F.col(q(eid)) == F.col(q(scope[edge.var].column)))
        scope[evar] = ebind
        if not y_bound and not loop:
            complete = far is not None and (self.needed[y] & set(self.graph.node_props(far))) <= set(nprops["v"])
            scope[y] = Binding(v, "node", far, props=nprops["v"], loaded=complete)
        out = Rows(joined, scope)
        if edge.props:
            out = self.with_props(out, evar, edge.props)
        if not loop:
            out = self.far_node(out, y, node)
        return out

    def far_node(self, rows: Rows, y: str, node: NodeP) -> Rows:
        """Label, properties and property predicates of a node just reached, with one join at
        most: reading a label's table for properties tests the label too."""
        b = rows.scope[y]
        kinds = self.graph.node_props(node.label if node.label is not None else b.label)
        missing = (self.needed.get(y, set()) & set(kinds)) - set(b.props)
        if node.label is not None and b.label is None and missing and not b.loaded:
            rows = Rows(rows.df, {**rows.scope, y: replace(b, label=node.label)})
            rows = self.load(rows, y)
        else:
            rows = self.load(self.with_label(rows, y, node.label), y)
        return self.with_props(rows, y, node.props)

    def repeat(self, rows: Rows, x: str, edge: EdgeP, y: str, node: NodeP, trail: bool, backwards: bool) -> Rows:
        """Bounded repetition, unrolled: each depth is one more join on the rows of the depth
        before, and a row comes out for each path of an allowed length. From the least length
        on a row is doubled, to stay as it is and to go one edge further, so every depth reads
        the adjacency once and the rows before it once. The last edge to a node that is bound
        already joins on both ends. The path of edge ids is kept only for TRAIL or where the
        edge variable is read."""
        low, high = edge.bounds
        direction = REVERSED[edge.direction] if backwards else edge.direction
        keys = {k for k, _ in edge.props}
        kinds = self.graph.edge_props(edge.label)
        keep = trail or edge.var is not None
        near, far = self.implied(edge, backwards)
        y_bound = y in rows.scope
        self.needed.setdefault(y, set()).update(k for k, _ in node.props)
        if rows.scope[x].column == "":
            raise Unsupported("a quantified edge needs its start node")
        base, scope = rows.df, dict(rows.scope)
        front, path = self.name(y), self.name(edge.var or "_p")
        current = base.withColumn(front, F.col(q(scope[x].column)))
        if keep:
            current = current.withColumn(path, F.array().cast("array<string>"))
        current = current.where(F.col(q(front)).isNotNull())
        live = None  # rows that may still grow
        for depth in range(1, high + 1):
            adj = oriented(self.graph, edge.label, direction, keys)
            u, v, eid, go = self.name("u"), self.name("v"), self.name("i"), self.name("go")
            if edge.props:
                props = {k: (k, kinds[k]) for k in keys & set(kinds)}
                inner = {"_edge": Binding("eid", "edge", edge.label, props=props)}
                constant = [(k, e) for k, e in edge.props if not names(e)]
                for k, e in constant:
                    adj = adj.where(X.equal(self.value(Prop("_edge", k), inner), self.value(e, scope)))
            extra = {k: self.name(k) for k in sorted(keys & set(kinds))}
            adj = adj.select(F.col("u").alias(u), F.col("v").alias(v), F.col("eid").alias(eid), *(F.col(q(k)).alias(c) for k, c in extra.items()))
            grows, condition = depth > low, F.col(q(front)) == F.col(q(u))
            if grows:
                both = F.array(F.lit(False), F.lit(True))
                chosen = both if live is None else F.when(F.col(q(live)), both).otherwise(F.array(F.lit(False)))
                current = current.withColumn(go, F.explode(chosen))
                condition &= F.col(q(go))
            if y_bound and depth == high:
                condition &= F.col(q(scope[y].column)) == F.col(q(v))
            current = current.join(adj, condition, "left" if grows else "inner")
            kept = [F.col(q(u)).isNotNull()] if grows else []
            for k, e in edge.props:
                if names(e):
                    own = Value(F.col(q(extra[k])), kinds[k]) if k in extra else Value(F.lit(None), "null")
                    kept.append(X.equal(own, self.value(e, scope)))
            if trail and depth > 1:
                kept.append(~F.array_contains(q(path), F.col(q(eid))))
            for one in kept:
                current = current.where(~F.col(q(go)) | one if grows else one)
            if keep:
                grown = F.concat(F.array(eid), F.col(q(path))) if backwards else F.concat(F.col(q(path)), F.array(eid))
                current = current.withColumn(path, F.when(F.col(q(go)), grown).otherwise(F.col(q(path))) if grows else grown)
            current = current.withColumn(front, F.when(F.col(q(go)), F.col(q(v))).otherwise(F.col(q(front))) if grows else F.col(q(v)))
            current = current.drop(u, v, eid, *extra.values(), *([live] if live else []))
            live = go if grows else None
        out = current.drop(live) if live else current
        if high < low:
            out = out.where(F.lit(False))
        if y_bound:
            out = out.where(F.col(q(front)) == F.col(q(scope[y].column)))
        else:
            same = scope[x].label if low == 0 else None
            label = far if low > 0 or far == same else None
            scope[y] = Binding(front, "node", label)
        if edge.var is not None:
            scope[edge.var] = Binding(path, "list", edge.label, item="edge")
        return self.far_node(Rows(out, scope), y, node)

    # Clauses

    def where(self, rows: Rows, where: Where | None) -> Rows:
        if where is None:
            return rows
        if where.path is None:
            rows = self.load_all(rows, names(where.expr))
            return Rows(self.start(rows).where(self.predicate(where.expr, rows.scope)), rows.scope)
        return self.correlated(rows, (where.path,), None, "left_anti" if where.negated else "left_semi")

    def match(self, rows: Rows, match: Match) -> Rows:
        if match.optional:
            return self.correlated(rows, match.paths, match.where, "left")
        for path in match.paths:
            rows = self.path(rows, path)
        return self.where(rows, match.where)

    def outer_names(self, rows: Rows, paths: tuple[Path, ...], where: Where | None) -> list[str]:
        used: set[str] = set()
        for p in [*paths, *([where.path] if where is not None and where.path is not None else [])]:
            for part in (*p.nodes, *p.edges):
                used |= {part.var} if part.var else set()
                for _, expr in part.props:
                    used |= names(expr)
        if where is not None and where.expr is not None:
            used |= names(where.expr)
        return sorted(used & set(rows.scope))

    def direct(self, rows: Rows, paths: tuple[Path, ...], where: Where | None, n: str, how: str) -> Rows | None:
        """A correlated part of one edge whose only tie to the rows is the node ``n`` at one of
        its ends: the edge is read by itself and joined once. None for any other part."""
        path, binding = paths[0], rows.scope[n]
        if len(paths) > 1 or binding.kind != "node" or len(path.edges) != 1 or path.edges[0].bounds is not None or where is not None and where.path is not None:
            return None
        read = {x for part in (*path.nodes, *path.edges) for _, e in part.props for x in names(e)} | (names(where.expr) if where is not None else set())
        mine = [x for x in path.nodes if x.var == n]
        if n in read or path.edges[0].var == n or len(mine) != 1 or mine[0].props or mine[0].label not in (None, binding.label):
            return None
        own, key = self.name("_o"), self.name("k")
        part = replace(path, nodes=tuple(replace(x, var=own, label=None) if x.var == n else x for x in path.nodes))
        right = self.where(self.path(Rows(None, {own: Binding("", "node")}), part), where)
        made = {k: replace(b, nullable=True) for k, b in right.scope.items() if k != own}
        wanted = [q(c) for b in made.values() for c in b.columns] if how == "left" else []
        side = right.df.select(F.col(q(right.scope[own].column)).alias(key), *wanted)
        joined = rows.df.join(side, F.col(q(binding.column)) == F.col(q(key)), how)
        return Rows(joined.drop(key), {**rows.scope, **made}) if how == "left" else Rows(joined, rows.scope)

    def correlated(self, rows: Rows, paths: tuple[Path, ...], where: Where | None, how: str) -> Rows:
        outer = self.outer_names(rows, paths, where)
        if rows.df is not None and len(outer) == 1 and (found := self.direct(rows, paths, where, outer[0], how)) is not None:
            return found
        left = self.load_all(rows, {n for n in outer if rows.scope[n].kind in ("node", "edge") and self.needed.get(n)}) if rows.df is not None else Rows(self.start(rows), rows.scope)
        if not outer:
            right = self.where(self.inner(Rows(None, {}), paths), where)
            made = {k: replace(b, nullable=True) for k, b in right.scope.items() if k not in left.scope}
            if how == "left":
                side = right.df.select(*(q(c) for b in made.values() for c in b.columns)) if made else right.df
                return Rows(left.df.join(side, F.lit(True), "left"), {**left.scope, **made})
            return Rows(left.df.join(right.df.select(F.lit(1).alias(self.name("k"))).limit(1), F.lit(True), how), left.scope)
        columns = [c for n in outer for c in left.scope[n].columns]
        distinct = left.df.select(*(q(c) for c in dict.fromkeys(columns)))
        identities = [left.scope[n].column for n in outer]
        distinct = distinct.dropDuplicates(identities) if len(identities) < len(set(columns)) else distinct.distinct()
        inner_scope = {n: replace(left.scope[n], nullable=False) for n in outer}
        for n in outer:  # a null reference matches nothing
            if left.scope[n].kind in ("node", "edge") and any(n in (p.var for p in (*path.nodes, *path.edges)) for path in paths):
                distinct = distinct.where(F.col(q(left.scope[n].column)).isNotNull())
        right = self.where(self.inner(Rows(distinct, inner_scope), paths), where)
        keys = {c: self.name("k") for c in identities}
        made = {k: b for k, b in right.scope.items() if k not in left.scope}
        wanted = [q(c) for b in made.values() for c in b.columns] if how == "left" else []
        side = right.df.select(*(F.col(q(c)).alias(k) for c, k in keys.items()), *wanted)
        if how != "left":
            side = side.distinct()
        condition = None
        for c, k in keys.items():
            nullable = next(left.scope[n] for n in outer if left.scope[n].column == c)
            one = F.col(q(c)).eqNullSafe(F.col(q(k))) if nullable.kind not in ("node", "edge") else F.col(q(c)) == F.col(q(k))
            condition = one if condition is None else condition & one
        joined = left.df.join(side, condition, how)
        if how == "left":
            joined = joined.drop(*keys.values())
        return Rows(joined, {**left.scope, **({k: replace(b, nullable=True, loaded=True) for k, b in made.items()} if how == "left" else {})})

    def inner(self, rows: Rows, paths: tuple[Path, ...]) -> Rows:
        for path in paths:
            rows = self.path(rows, path)
        return rows

    # Projection

    def items(self, rows: Rows, items, order=(), with_clause: bool = False) -> tuple[Rows, list[Output], list[tuple[str, bool]], bool]:
        """Project items (aggregating if any has an aggregate): the new rows, the outputs, and
        the columns of the sort keys."""
        wanted: set[str] = set()
        for item in items:
            wanted |= names(item.expr)
            if with_clause and item.alias is None and not isinstance(item.expr, Var):
                raise Unsupported("an item of WITH that isn't a variable needs an alias")
        outputs_by_name = {output_name(i): i for i in items}
        for expr, _ in order:
            wanted |= {n for n in names(expr) if n not in outputs_by_name}
        for n in wanted:
            self.bound(n, rows.scope)
        rows = self.load_all(rows, wanted)
        grouped = any(has_aggregate(i.expr) for i in items)
        df, scope = self.start(rows), rows.scope
        for item in items:
            if has_aggregate(item.expr):
                check_aggregate(item.expr)
        outputs, columns = [], []
        keys: list[Column] = []
        aggs: list[Column] = []
        post: list[Column] = []
        for item in items:
            name = output_name(item)
            column = self.name(name)
            if has_aggregate(item.expr):
                value, parts = self.aggregated(item.expr, scope)
                aggs += parts
                post.append(value.column.alias(column))
                binding = Binding(column, value.kind, value.label, value.item, nullable=True)
            else:
                value = self.value(item.expr, scope)
                binding = Binding(column, value.kind, value.label, value.item, nullable=True)
                carried = {}
                if value.kind in ("node", "edge"):
                    source = scope[item.expr.name] if isinstance(item.expr, Var) else None
                    binding.nullable = source.nullable if source else True
                    for k, (c, kind) in (source.props if source else {}).items():
                        carried[k] = (self.name(f"{name}.{k}"), kind)
                        (aggs if grouped else columns).append((F.first(q(c)) if grouped else F.col(q(c))).alias(carried[k][0]))
                        if grouped:
                            post.append(F.col(q(carried[k][0])))
                    binding.props = carried
                    binding.loaded = bool(source and source.loaded and self.needed.get(name, set()) <= self.needed.get(item.expr.name, set()))
                cast = value.column.cast("bigint") if value.kind == "null" else value.column
                (keys if grouped else columns).append(cast.alias(column))
                if grouped:
                    post.append(F.col(q(column)))
            outputs.append(Output(name, column, binding))
        new_scope = {o.name: o.binding for o in outputs}
        sort: list[tuple[str, bool]] = []
        hidden: list[tuple[str, object]] = []
        for expr, down in order:
            if isinstance(expr, Var) and expr.name in new_scope:
                sort.append((new_scope[expr.name].column, down))
                continue
            if has_aggregate(expr):
                raise Unsupported("sort by the alias of an aggregate")
            column = self.name("sort")
            mixed = {**scope, **new_scope}
            if names(expr) & set(new_scope) and not names(expr) <= set(scope):
                hidden.append((column, (expr, mixed, True)))
            else:
                hidden.append((column, (expr, scope, False)))
            sort.append((column, down))
        before = [(c, self.value(e, s).column) for c, (e, s, late) in hidden if not late]
        if grouped:
            aggs += [F.first(v).alias(c) for c, v in before]
            made = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
            out = made.select(*post, *(F.col(q(c)) for c, _ in before))
        else:
            out = df.select(*columns, *(v.alias(c) for c, v in before))
        for c, (e, s, late) in hidden:
            if late:
                out = out.withColumn(c, self.value(e, s).column)
        return Rows(out, new_scope), outputs, sort, bool(hidden)

    def aggregated(self, expr, scope: dict[str, Binding]) -> tuple[Value, list[Column]]:
        """An expression over aggregates: its value after grouping, and the aggregates."""
        if isinstance(expr, Agg):
            inner = None if expr.arg is None else self.value(expr.arg, scope)
            value, column = X.aggregate(expr.name, inner, expr.distinct), self.name(expr.name)
            return Value(F.col(q(column)), value.kind), [value.column.alias(column)]
        if isinstance(expr, Bin):
            (a, x), (b, y) = self.aggregated(expr.left, scope), self.aggregated(expr.right, scope)
            return X.binary(expr.op, a, b), x + y
        if isinstance(expr, Not):
            a, x = self.aggregated(expr.inner, scope)
            return Value(~X.truthy(a), "bool"), x
        if isinstance(expr, Index):
            (a, x), (b, y) = self.aggregated(expr.base, scope), self.aggregated(expr.place, scope)
            return X.index(a, b), x + y
        return self.value(expr, scope), []

    def clauses(self, clauses) -> Rows:
        rows = Rows(None, {})
        for clause in clauses:
            if isinstance(clause, Match):
                rows = self.match(rows, clause)
            elif isinstance(clause, With):
                rows, outputs, _, _ = self.items(rows, clause.items, with_clause=True)
                for o in outputs:
                    if o.binding.kind in ("node", "edge") and not o.binding.loaded:
                        rows = self.load(rows, o.name)
        return rows

    def row_query(self, query: RowQuery) -> tuple[DataFrame, list[Output]]:
        return self.returned(self.clauses(query.clauses), query.ret)

    def returned(self, rows: Rows, ret: Return) -> tuple[DataFrame, list[Output]]:
        rows, outputs, sort, hidden = self.items(rows, ret.items, ret.order)
        df = rows.df
        if ret.distinct:
            own = [q(o.column) for o in outputs]
            rest = [c for c in df.columns if c not in {o.column for o in outputs}]
            df = df.groupBy(*own).agg(*(F.first(q(c)).alias(c) for c in rest)) if rest else df.distinct()
        if sort:
            df = df.orderBy(*(F.col(q(c)).desc_nulls_first() if down else F.col(q(c)).asc_nulls_last() for c, down in sort))
        if ret.skip:
            df = df.offset(ret.skip)
        if ret.limit is not None:
            df = df.limit(ret.limit)
        return df.select(*(q(o.column) for o in outputs)), outputs

    def union(self, union: Union) -> tuple[DataFrame, list[Output]]:
        df, outputs = self.row_query(union.parts[0])
        for part, all_ in zip(union.parts[1:], union.alls):
            other, more = self.row_query(part)
            if len(more) != len(outputs):
                raise Unsupported("the parts of a UNION have different numbers of columns")
            left, right = [], []
            for a, b in zip(outputs, more):
                kinds = {a.binding.kind, b.binding.kind} - {"null"}
                if len(kinds) > 1 and kinds != {"int", "float"}:
                    raise Unsupported("the parts of a UNION have columns of different kinds")
                to = "double" if kinds == {"int", "float"} else None
                a_col, b_col = F.col(q(a.column)), F.col(q(b.column))
                if a.binding.kind == "null" and b.binding.kind != "null":
                    a_col = F.lit(None).cast(other.schema[b.column].dataType)
                if b.binding.kind == "null" and a.binding.kind != "null":
                    b_col = F.lit(None).cast(df.schema[a.column].dataType)
                left.append((a_col.cast(to) if to else a_col).alias(a.column))
                right.append((b_col.cast(to) if to else b_col).alias(a.column))
                a.binding.kind = "float" if to else next(iter(kinds), "null")
                a.binding.label = a.binding.label if a.binding.label == b.binding.label else None
            df = df.select(*left).unionAll(other.select(*right))
            if not all_:
                df = df.distinct()
        return df, outputs


def q(column: str) -> str:
    return f"`{column}`"


def output_name(item) -> str:
    if item.alias:
        return item.alias
    expr = item.expr
    if isinstance(expr, (Var, Param)):
        return expr.name
    if isinstance(expr, Prop):
        return f"{expr.var}.{expr.key}"
    if isinstance(expr, Lit):
        return "value"
    return expr.name if isinstance(expr, Agg) else "expr"


def check_aggregate(expr) -> None:
    """Beside aggregates only literals and parameters; no aggregate within another."""
    if isinstance(expr, Agg):
        if expr.arg is not None and has_aggregate(expr.arg):
            raise Unsupported("an aggregate within an aggregate")
        return
    if isinstance(expr, (Var, Prop)):
        raise Unsupported("an aggregate can't be mixed with a variable in one item")
    for name in ("base", "place", "inner", "left", "right"):
        below = getattr(expr, name, None)
        if below is not None:
            check_aggregate(below)
