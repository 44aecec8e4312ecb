"""A mutable graph: immutable versions in Parquet, and transactions over a snapshot.

A version is a folder with a node table and an edge table; a commit claims the next version
number by creating its manifest, which succeeds for one writer only. A transaction reads the
version it began on plus its own changes. A commit fails with Busy if a version since then
touched an element that it touched too, or an endpoint of an edge that it inserted; otherwise
its changes are applied to the newest version.
"""

from __future__ import annotations

import itertools
import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.expressions import Value
from trailweave.operators.lower import Lowering, q
from trailweave.plans.errors import Busy, UnknownIdentifier, Unsupported, WrongType
from trailweave.plans.tree import Change, Delete, Finish, Insert, Match
from trailweave.sources.graph import MIXED, Graph, merged, tagged

NODES = f"id bigint, labels array<string>, props map<string,{MIXED}>"
EDGES = f"eid bigint, src bigint, dst bigint, directed boolean, labels array<string>, props map<string,{MIXED}>"
TAGS = {1: "string", 2: "int", 3: "float", 7: "bool", 8: "null"}


class StoreGraph(Graph):
    """A snapshot as lowering reads it. The kinds of a property are those that occur; where
    they differ, its values keep their tags."""

    one_label = False

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame):
        self.spark, self.node_df, self.edge_df, self.kinds = spark, nodes, edges, {}

    def _kinds(self, which: str) -> dict[str, str]:
        if which not in self.kinds:
            df = self.node_df if which == "node" else self.edge_df
            seen = df.select(F.explode("props").alias("k", "v")).select("k", F.coalesce("v.t", F.lit(8)).alias("t")).distinct().collect()
            found: dict[str, set[str]] = {}
            for r in seen:
                found.setdefault(r["k"], set()).add(TAGS[r["t"]])
            self.kinds[which] = {k: merged(v) for k, v in sorted(found.items())}
        return self.kinds[which]

    def node_labels(self) -> list[str]:
        return sorted(r[0] for r in self.node_df.select(F.explode("labels")).distinct().collect())

    def node_props(self, label: str | None) -> dict[str, str]:
        return self._kinds("node")

    def edge_props(self, label: str | None) -> dict[str, str]:
        return self._kinds("edge")

    @staticmethod
    def _prop(key: str, kind: str) -> Column:
        value = F.get(F.map_values(F.map_filter("props", lambda k, _: k == key)), 0)
        if kind == "mixed":
            return F.when(value["t"] != 8, value)
        if kind == "float":
            return F.coalesce(value["f"], value["i"].cast("double"))
        return {"string": value["s"], "int": value["i"], "bool": value["b"]}.get(kind, F.lit(None))

    def _select(self, df: DataFrame, kinds: dict[str, str], label: str | None, props: set[str] | None, first: list, labels: bool) -> DataFrame:
        wanted = sorted(kinds if props is None else props & set(kinds))
        rows = df if label is None else df.where(F.array_contains("labels", label))
        return rows.select(*first, *(["labels"] if labels else []), *(self._prop(k, kinds[k]).alias(k) for k in wanted))

    def nodes(self, label: str | None, props: set[str] | None = None, labels: bool = False) -> DataFrame:
        return self._select(self.node_df, self.node_props(label), label, props, ["id"], labels)

    def edges(self, label: str | None, props: set[str] | None = None, labels: bool = False) -> DataFrame:
        first = [F.col("eid").cast("string").alias("eid"), "src", "dst", "directed"]
        return self._select(self.edge_df, self.edge_props(label), label, props, first, labels)

    def directedness(self, label: str | None) -> bool | None:
        return None

    def ends(self, label: str | None) -> tuple[str | None, str | None]:
        return None, None

    def inline(self, label: str | None) -> dict[str, dict[str, str]]:
        return {}

    def derived(self, label: str | None) -> bool:
        return False


class Store:
    """Versions below ``path``; without one, in the shared folder of spark.checkpoint.dir, or
    in a temporary folder where that is unset."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        if path is None:
            base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="trailweave-store-")
            path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
        self.path = path.rstrip("/")
        jvm = spark._jvm
        self.hadoop = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.newest() is None:
            empty = {"nodes": [], "edges": [], "touched": []}
            self._claim(0, empty)

    def _file(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{version:08d}.json")

    def newest(self) -> int | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self.hadoop.exists(folder):
            return None
        found = [int(s.getPath().getName()[9:-5]) for s in self.hadoop.listStatus(folder) if s.getPath().getName().startswith("manifest-")]
        return max(found, default=None)

    def manifest(self, version: int) -> dict:
        stream = self.hadoop.open(self._file(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _claim(self, version: int, content: dict) -> bool:
        """Write the whole manifest aside, then rename it to its name, which must be free."""
        temporary = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/.tmp-{uuid.uuid4().hex}")
        out = self.hadoop.create(temporary, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.hadoop.exists(self._file(version)) or not self.hadoop.rename(temporary, self._file(version)):
            self.hadoop.delete(temporary, False)
            return False
        return True

    def tables(self, version: int) -> tuple[DataFrame, DataFrame]:
        content = self.manifest(version)
        read = lambda paths, schema: self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return read(content["nodes"], NODES), read(content["edges"], EDGES)

    def begin(self) -> Transaction:
        return Transaction(self, self.newest())

    def write(self, df: DataFrame, label: str) -> str:
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path


class Transaction:
    """Changes over a snapshot. Every mutation reads first and writes then, so it never sees
    its own changes. New tables are written at once: random ids are drawn only once."""

    def __init__(self, store: Store, version: int):
        self.store, self.spark, self.version = store, store.spark, version
        self.nodes, self.edges = store.tables(version)
        self.changes: list[tuple] = []
        self.touched: list[DataFrame] = []

    def graph(self) -> StoreGraph:
        return StoreGraph(self.spark, self.nodes, self.edges)

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.store.write(df, label))

    def _apply(self, change: tuple) -> None:
        self.nodes, self.edges = apply(self.nodes, self.edges, change)
        self.changes.append(change)

    def mutate(self, statement, params: dict | None) -> int:
        lowering = Lowering(self.graph(), params, statement)
        if isinstance(statement, Finish):
            return lowering.match(lowering.clauses(()), statement.match).df.count()
        rows = lowering.clauses([statement.match] if statement.match else [])
        if isinstance(statement, Insert):
            return self._insert(lowering, rows, statement)
        if isinstance(statement, Change):
            return self._change(lowering, rows, statement)
        if isinstance(statement, Delete):
            return self._delete(rows, statement)
        raise Unsupported(type(statement).__name__)

    def _insert(self, lowering: Lowering, rows, statement: Insert) -> int:
        from trailweave.operators.lower import Rows
        from trailweave.plans.tree import names

        read = {n for p in statement.paths for part in (*p.nodes, *p.edges) for _, e in part.props for n in names(e)}
        for n in read:
            lowering.bound(n, rows.scope)
        rows = lowering.load_all(Rows(lowering.start(rows), rows.scope), read)
        df, scope = rows.df, rows.scope
        ids: dict[str, str] = {v: b.column for v, b in scope.items() if b.kind == "node"}
        fresh = itertools.count()
        node_parts, edge_parts, drawn = [], [], []
        for path in statement.paths:
            ends = []
            for node in path.nodes:
                if node.var in ids:
                    ends.append(ids[node.var])
                    continue
                if node.var is not None and node.var in scope:
                    raise WrongType(f"{node.var} is no node")
                column = f"new_{next(fresh)}"
                drawn.append(column)
                ids[node.var or column] = column
                ends.append(column)
                node_parts.append((column, node))
            for edge, left, right in zip(path.edges, ends, ends[1:]):
                if edge.var is not None and edge.var in scope:
                    raise Unsupported(f"{edge.var} is bound already")
                column = f"new_{next(fresh)}"
                drawn.append(column)
                if edge.direction == "left":
                    left, right = right, left
                edge_parts.append((column, edge, left, right))
        for column in drawn:
            df = df.withColumn(column, F.xxhash64(F.uuid()).bitwiseAND(F.lit((1 << 63) - 1)))
        values: dict[int, str] = {}
        for part in [p for _, p in node_parts] + [e for _, e, _, _ in edge_parts]:
            pairs = [(k, lowering.value(e, scope)) for k, e in part.props]
            made = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(_stored(v) for _, v in pairs))) if pairs else F.create_map().cast(f"map<string,{MIXED}>")
            column = f"props_{len(values)}"
            values[id(part)] = column
            df = df.withColumn(column, made)
        df = self._keep(df.select(*drawn, *values.values(), *(q(c) for c in dict.fromkeys(ids.values()) if c not in drawn)), "insert")
        label = lambda part: F.array(F.lit(part.label)) if part.label else F.array().cast("array<string>")
        if node_parts:
            made = reduce(DataFrame.unionAll, [df.select(F.col(c).alias("id"), label(n).alias("labels"), F.col(values[id(n)]).alias("props")) for c, n in node_parts])
            self._apply(("insert_nodes", made))
        if edge_parts:
            made = reduce(DataFrame.unionAll, [df.where(F.col(q(a)).isNotNull() & F.col(q(b)).isNotNull()).select(F.col(c).alias("eid"), F.col(q(a)).alias("src"), F.col(q(b)).alias("dst"), F.lit(e.direction in ("left", "right")).alias("directed"), label(e).alias("labels"), F.col(values[id(e)]).alias("props")) for c, e, a, b in edge_parts])
            self._apply(("insert_edges", made))
            self.touched.append(made.select(F.explode(F.array("src", "dst")).alias("id")))
        count = df.count()
        return count * (len(node_parts) + len(edge_parts))

    def _change(self, lowering: Lowering, rows, statement: Change) -> int:
        from trailweave.plans.tree import names

        total = 0
        for item in statement.items:
            lowering.bound(item.var, rows.scope)
            if item.value is not None:
                for n in names(item.value):
                    lowering.bound(n, rows.scope)
                rows = lowering.load_all(rows, names(item.value))
        planned = []
        for item in statement.items:
            binding = rows.scope[item.var]
            if binding.kind not in ("node", "edge"):
                raise WrongType(f"{item.var} is no node or edge")
            target = rows.df.where(F.col(q(binding.column)).isNotNull()).select(F.col(q(binding.column)).cast("bigint").alias("id"), *([_stored(lowering.value(item.value, rows.scope)).alias("value")] if item.key else []))
            planned.append((item, binding.kind, self._keep(target, "change")))
        for item, kind, target in planned:
            if item.key:
                # Of several rows for one element the greatest value holds, whatever their order.
                self._apply(("set", kind, item.key, self._keep(target.groupBy("id").agg(F.max("value").alias("value")), "set")))
                total += target.count()
            else:
                table = (self.nodes if kind == "node" else self.edges.withColumnRenamed("eid", "id")).select("id", "labels")
                has = F.array_contains("labels", item.label)
                changed = self._keep(table.join(target.distinct(), "id", "left_semi").where(has if statement.remove else ~has).select("id"), "label")
                self._apply(("unlabel" if statement.remove else "label", kind, item.label, changed))
                total += changed.count()
            self.touched.append(target.select("id"))
        return total

    def _delete(self, rows, statement: Delete) -> int:
        total = 0
        planned = []
        for var in statement.vars:
            if var not in rows.scope:
                raise UnknownIdentifier(var)
            binding = rows.scope[var]
            if binding.kind not in ("node", "edge"):
                raise WrongType(f"{var} is no node or edge")
            planned.append((binding.kind, self._keep(rows.df.select(F.col(q(binding.column)).cast("bigint").alias("id")).where("id IS NOT NULL").distinct(), "delete")))
        for kind, ids in sorted(planned, key=lambda p: p[0] != "edge"):
            if kind == "edge":
                total += self.edges.join(ids.withColumnRenamed("id", "eid"), "eid", "left_semi").count()
                self._apply(("delete_edges", ids))
            else:
                total += self.nodes.join(ids, "id", "left_semi").count()
                attached = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("eid").union(self.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("eid")).distinct()
                attached = self._keep(attached.withColumnRenamed("eid", "id"), "attached")
                if statement.detach:
                    total += attached.count()
                self._apply(("delete_edges", attached))
                self._apply(("delete_nodes", ids))
            self.touched.append(ids)
        return total

    def commit(self) -> None:
        """Apply the changes to the newest version; Busy if another commit touched the same."""
        if not self.changes:
            return
        touched = reduce(DataFrame.unionAll, [t.select("id") for t in self.touched]).distinct() if self.touched else self.spark.createDataFrame([], "id bigint")
        path = self.store.write(touched, "touched")
        mine = self.spark.read.schema("id bigint").parquet(path)
        while True:
            newest = self.store.newest()
            for version in range(self.version + 1, newest + 1):
                others = self.store.manifest(version)["touched"]
                if others and mine.join(self.spark.read.schema("id bigint").parquet(*others), "id", "left_semi").limit(1).count():
                    raise Busy(f"version {version} touched the same elements")
            nodes, edges = (self.nodes, self.edges) if newest == self.version else self._again(newest)
            content = {"nodes": [self.store.write(nodes, "nodes")], "edges": [self.store.write(edges, "edges")], "touched": [path]}
            if self.store._claim(newest + 1, content):
                return

    def _again(self, version: int) -> tuple[DataFrame, DataFrame]:
        tables = self.store.tables(version)
        for change in self.changes:
            tables = apply(*tables, change)
        return tables


def _stored(value: Value) -> Column:
    """A value with its tag; null is stored too."""
    if value.kind in ("node", "edge", "list"):
        raise Unsupported("a reference or list can't be stored as a property")
    none = F.struct(F.lit(8).cast("tinyint").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"))
    return F.coalesce(tagged(value.column, value.kind), none)


def apply(nodes: DataFrame, edges: DataFrame, change: tuple) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables after one change."""
    kind = change[0]
    if kind == "insert_nodes":
        return nodes.unionByName(change[1]), edges
    if kind == "insert_edges":
        return nodes, edges.unionByName(change[1])
    if kind == "delete_nodes":
        return nodes.join(change[1], "id", "left_anti"), edges
    if kind == "delete_edges":
        return nodes, edges.join(change[1].withColumnRenamed("id", "eid"), "eid", "left_anti").select(*edges.columns)
    on_nodes = change[1] == "node"
    table, key = (nodes, "id") if on_nodes else (edges, "eid")
    side = change[3].withColumnRenamed("id", key).withColumn("hit__", F.lit(True))
    joined = table.join(side, key, "left")
    if kind == "set":
        name = change[2]
        new = F.map_concat(F.map_filter("props", lambda k, _: k != name), F.map_from_arrays(F.array(F.lit(name)), F.array("value")))
        joined = joined.withColumn("props", F.when(F.col("hit__"), new).otherwise(F.col("props")))
    else:
        new = F.array_union("labels", F.array(F.lit(change[2]))) if kind == "label" else F.array_remove("labels", change[2])
        joined = joined.withColumn("labels", F.when(F.col("hit__"), new).otherwise(F.col("labels")))
    out = joined.select(*table.columns)
    return (out, edges) if on_nodes else (nodes, out)
