"""The catalog of a property graph: vertex and edge tables as DataFrames.

Node ids are BIGINT and unique over all labels. Edge ids are strings; their columns are
computed only where edge identity is used, since Catalyst prunes them otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Static kinds of expressions and properties.
KINDS = ("int", "float", "string", "bool", "null", "node", "edge", "list", "mixed")
SPARK_TYPES = {"int": "bigint", "float": "double", "string": "string", "bool": "boolean", "null": "void"}


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.StructType):
        return "mixed"
    return "null"


@dataclass
class Vertices:
    """Nodes of one label: ``df`` has ``id`` and the properties."""

    label: str
    df: DataFrame
    props: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.props = {f.name: kind_of(f.dataType) for f in self.df.schema if f.name != "id"}


@dataclass
class Edges:
    """Edges of one label: ``df`` has ``eid``, ``src``, ``dst`` and the properties.

    ``ends`` are the labels of the endpoints where they are always the same. ``inline`` says
    for an end ("src", "dst") which of its node's properties the same table holds, by column
    name: they are then read without a join. ``derived``: the table is an aggregation, below
    which a semi-join on an end goes.
    """

    label: str
    df: DataFrame
    directed: bool = True
    ends: tuple[str | None, str | None] = (None, None)
    inline: dict[str, dict[str, str]] = field(default_factory=dict)
    derived: bool = False
    props: dict[str, str] = field(init=False)

    def __post_init__(self):
        hidden = {"eid", "src", "dst", *(c for m in self.inline.values() for c in m.values())}
        self.props = {f.name: kind_of(f.dataType) for f in self.df.schema if f.name not in hidden}


def merged(kinds: set[str]) -> str:
    """The kind of a property over several tables."""
    kinds = kinds - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return next(iter(kinds))
    return "float" if kinds == {"int", "float"} else "mixed"


MIXED = "struct<t:tinyint,s:string,i:bigint,f:double,b:boolean>"


def tagged(value: Column, kind: str) -> Column:
    """A value of a property that has different kinds in different places."""
    slots = {"string": (1, "s"), "int": (2, "i"), "float": (3, "f"), "bool": (7, "b")}
    if kind == "mixed":
        return value
    tag, own = slots.get(kind, (8, ""))
    types = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
    made = F.struct(F.lit(tag).cast("tinyint").alias("t"), *((value if c == own else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    return F.when(value.isNotNull(), made) if own else F.lit(None).cast(MIXED)


def as_kind(value: Column, kind: str, to: str) -> Column:
    if kind == to:
        return value
    if to == "mixed":
        return tagged(value, kind)
    return value.cast(SPARK_TYPES[to])


class Tables(Mapping):
    """Tables by label, each made when first asked for: a query opens only what it names."""

    def __init__(self, makers: dict[str, Callable]):
        self.makers, self.made = makers, {}

    def __getitem__(self, label: str):
        if label not in self.made:
            self.made[label] = self.makers[label]()
        return self.made[label]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def __contains__(self, label) -> bool:
        return label in self.makers


class Graph:
    """Typed tables for each label. ``nodes`` and ``edges`` are what lowering reads."""

    def __init__(self, spark: SparkSession, vertices: list[Vertices] | dict[str, Callable], edges: list[Edges] | dict[str, Callable]):
        self.spark = spark
        self.vertices = Tables(vertices) if isinstance(vertices, dict) else {v.label: v for v in vertices}
        self.edge_tables = Tables(edges) if isinstance(edges, dict) else {e.label: e for e in edges}

    def node_labels(self) -> list[str]:
        return list(self.vertices)

    def node_props(self, label: str | None) -> dict[str, str]:
        tables = [self.vertices[label]] if label in self.vertices else [] if label is not None else list(self.vertices.values())
        keys = {k for t in tables for k in t.props}
        return {k: merged({t.props.get(k, "null") for t in tables}) for k in sorted(keys)}

    def nodes(self, label: str | None, props: set[str] | None = None, labels: bool = False) -> DataFrame:
        """``id`` and properties (all if None) of nodes of a label, or of all; an unknown label
        has none. ``labels``: their names too, as an array ``labels``."""
        kinds = self.node_props(label)
        wanted = sorted(kinds if props is None else props & set(kinds))
        tables = [self.vertices[label]] if label in self.vertices else [] if label is not None else list(self.vertices.values())
        if not tables:
            return self.spark.range(0).select("id", *([F.array().cast("array<string>").alias("labels")] if labels else []))
        parts = []
        for t in tables:
            own = [as_kind(F.col(k), t.props[k], kinds[k]).alias(k) if k in t.props else F.lit(None).cast(MIXED if kinds[k] == "mixed" else SPARK_TYPES[kinds[k]]).alias(k) for k in wanted]
            parts.append(t.df.select("id", *([F.array(F.lit(t.label)).alias("labels")] if labels else []), *own))
        return reduce(DataFrame.unionAll, parts)

    def edge_choice(self, label: str | None) -> list[Edges]:
        return [self.edge_tables[label]] if label in self.edge_tables else [] if label is not None else list(self.edge_tables.values())

    def edge_props(self, label: str | None) -> dict[str, str]:
        tables = self.edge_choice(label)
        return {k: merged({t.props.get(k, "null") for t in tables}) for k in sorted({k for t in tables for k in t.props})}

    def edges(self, label: str | None, props: set[str] | None = None, labels: bool = False) -> DataFrame:
        """``eid``, ``src``, ``dst``, ``directed`` and properties (all if None)."""
        kinds = self.edge_props(label)
        wanted = sorted(kinds if props is None else props & set(kinds))
        parts = []
        for t in self.edge_choice(label):
            own = [as_kind(F.col(k), t.props[k], kinds[k]).alias(k) if k in t.props else F.lit(None).cast(MIXED if kinds[k] == "mixed" else SPARK_TYPES[kinds[k]]).alias(k) for k in wanted]
            parts.append(t.df.select("eid", "src", "dst", F.lit(t.directed).alias("directed"), *([F.array(F.lit(t.label)).alias("labels")] if labels else []), *own))
        if not parts:
            return self.spark.range(0).select(F.lit("").alias("eid"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("directed"), *([F.array().cast("array<string>").alias("labels")] if labels else []))
        return reduce(DataFrame.unionAll, parts)

    def directedness(self, label: str | None) -> bool | None:
        """Whether all edges of a label are directed; None if they differ or it isn't known."""
        found = {t.directed for t in self.edge_choice(label)}
        return found.pop() if len(found) == 1 else None

    def ends(self, label: str | None) -> tuple[str | None, str | None]:
        """Labels that the source and the target of every edge have."""
        tables = self.edge_choice(label)
        return tables[0].ends if len(tables) == 1 else (None, None)

    def inline(self, label: str | None) -> dict[str, dict[str, str]]:
        tables = self.edge_choice(label)
        return tables[0].inline if len(tables) == 1 else {}

    def derived(self, label: str | None) -> bool:
        tables = self.edge_choice(label)
        return len(tables) == 1 and tables[0].derived

    def edge_frame(self, label: str) -> DataFrame:
        return self.edge_tables[label].df

    #: Whether a node has one label only, so that two different ones exclude each other.
    one_label = True


def oriented(graph: Graph, label: str | None, direction: str, props: set[str]) -> DataFrame:
    """Adjacency ``u, v, eid`` and properties: every edge as seen from ``u`` in a direction.

    A directed edge is seen as outgoing from its source and as incoming from its target; an
    undirected one the same way from both, once if it is a loop. Where the edge's table holds
    properties of its ends, they come as ``u.<key>`` and ``v.<key>``.
    """
    parts = {"left": "I", "right": "O", "undirected": "S", "left_or_undirected": "SI", "right_or_undirected": "OS", "left_or_right": "OI", "any": "OSI"}[direction]
    known, inline = graph.directedness(label), graph.inline(label)
    base = graph.edge_frame(label) if inline else graph.edges(label, props)
    if inline:
        base = base.withColumn("directed", F.lit(known))
    keys = [k for k in graph.edge_props(label) if k in props]

    def view(u: str, v: str, condition) -> DataFrame:
        ends = [F.col(c).alias(f"{side}.{k}") for side, end in (("u", u), ("v", v)) for k, c in inline.get(end, {}).items()]
        rows = base if condition is None else base.where(condition)
        return rows.select(F.col(u).alias("u"), F.col(v).alias("v"), "eid", *keys, *ends)

    # An undirected edge has two orientations, whose inlined columns differ by side: only
    # directed tables inline, so the parts below agree in columns.
    out = []
    if known is not False:
        only = None if known else F.col("directed")
        out += [view("src", "dst", only)] if "O" in parts else []
        out += [view("dst", "src", only)] if "I" in parts else []
    if known is not True and "S" in parts:
        simple = ~F.col("directed")
        out += [view("src", "dst", None if known is False else simple), view("dst", "src", (F.col("src") != F.col("dst")) & (F.lit(True) if known is False else simple))]
    if not out:
        return view("src", "dst", F.lit(False))
    if len(out) > 1:
        shared = [c for c in out[0].columns if all(c in o.columns for o in out)]
        out = [o.select(*(f"`{c}`" for c in shared)) for o in out]
    return reduce(DataFrame.unionAll, out)
