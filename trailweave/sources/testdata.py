"""The driver's tables as a property graph. Ids are (ordinal of the label << 48) | key."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.sources.graph import Edges, Graph, Vertices

LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "Document", "Label", "Turn")


def node_id(label: str, key: Column) -> Column:
    return F.lit(LABELS.index(label) << 48) + key.cast("bigint")


def plain(df: DataFrame, prefix: str = "") -> DataFrame:
    """Columns without prefix, integers as 64-bit, timestamps as text."""
    def one(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name.removeprefix(prefix))

    return df.select(*(one(f) for f in df.schema))


def edge_id(label: str, *keys: str) -> Column:
    return F.concat_ws(":", F.lit(label), *(F.col(k).cast("string") for k in keys))


def turn_key() -> Column:
    return F.col("conv_id") * F.lit(1 << 20) + F.col("turn")


def load(spark: SparkSession, sf_dir: str) -> Graph:
    c = F.col

    @lru_cache(maxsize=None)
    def table(name: str, prefix: str = "") -> DataFrame:
        df = plain(spark.read.parquet(f"{sf_dir}/{name}.parquet"), prefix)
        return df.withColumnsRenamed({"o": {"orderstatus": "status"}, "l": {"extendedprice": "price"}}.get(prefix[:1], {}))

    def vertices(label: str, key: Column, *source: str) -> Callable[[], Vertices]:
        return lambda: Vertices(label, table(*source).withColumn("id", node_id(label, key)))

    def owned(label: str, end: str, src: Column, dst: Column, ends: tuple[str, str], key: tuple[str, ...], source: tuple[str, ...], props: tuple[str, ...] = (), rows: Callable = lambda df: df) -> Callable[[], Edges]:
        """Edges of a foreign key: the table of one end, whose properties come with them."""
        def make() -> Edges:
            df = table(*source)
            kept = [F.col(k).alias(f"{end}_{k}") for k in df.columns]
            made = rows(df).select(edge_id(label, *key).alias("eid"), src.alias("src"), dst.alias("dst"), *props, *kept)
            return Edges(label, made, ends=ends, inline={end: {k: f"{end}_{k}" for k in df.columns}})

        return make

    def neighbor() -> Edges:
        nation = table("nation", "n_").select("nationkey", "regionkey")
        other = nation.select(c("nationkey").alias("other"), "regionkey")
        near = nation.join(other, "regionkey").where("nationkey < other")
        return Edges("NEIGHBOR", near.select(edge_id("NEIGHBOR", "nationkey", "other").alias("eid"), node_id("Nation", c("nationkey")).alias("src"), node_id("Nation", c("other")).alias("dst")), directed=False, ends=("Nation", "Nation"))

    def contains() -> Edges:
        key = ("orderkey", "linenumber", "partkey", "suppkey", "quantity", "price", "shipdate")
        made = table("lineitem", "l_").select(edge_id("CONTAINS", *key).alias("eid"), node_id("Order", c("orderkey")).alias("src"), node_id("Part", c("partkey")).alias("dst"), "quantity", "price", "discount", "tax", "returnflag", "linestatus", "linenumber")
        return Edges("CONTAINS", made, ends=("Order", "Part"))

    def supplies() -> Edges:
        made = table("lineitem", "l_").select("suppkey", "partkey").distinct().select(edge_id("SUPPLIES", "suppkey", "partkey").alias("eid"), node_id("Supplier", c("suppkey")).alias("src"), node_id("Part", c("partkey")).alias("dst"))
        return Edges("SUPPLIES", made, ends=("Supplier", "Part"), derived=True)

    def following(turns: DataFrame) -> DataFrame:
        # A conversation's turns are numbered without gaps; its last has no next.
        last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
        return turns.join(last, "conv_id").where(c("turn") < c("last")).drop("last")

    nation, customer, supplier, orders = ("nation", "n_"), ("customer", "c_"), ("supplier", "s_"), ("orders", "o_")
    nodes = {
        "Region": vertices("Region", c("regionkey"), "region", "r_"),
        "Nation": vertices("Nation", c("nationkey"), *nation),
        "Customer": vertices("Customer", c("custkey"), *customer),
        "Supplier": vertices("Supplier", c("suppkey"), *supplier),
        "Part": vertices("Part", c("partkey"), "part", "p_"),
        "Order": vertices("Order", c("orderkey"), *orders),
        "Event": vertices("Event", c("event_id"), "events"),
        "Document": vertices("Document", c("doc_id"), "documents"),
        "Label": vertices("Label", c("doc_id"), "labels"),
        "Turn": vertices("Turn", turn_key(), "conversations"),
    }
    edges = {
        "IN_REGION": owned("IN_REGION", "src", node_id("Nation", c("nationkey")), node_id("Region", c("regionkey")), ("Nation", "Region"), ("nationkey",), nation),
        "LIVES_IN": owned("LIVES_IN", "src", node_id("Customer", c("custkey")), node_id("Nation", c("nationkey")), ("Customer", "Nation"), ("custkey",), customer),
        "BASED_IN": owned("BASED_IN", "src", node_id("Supplier", c("suppkey")), node_id("Nation", c("nationkey")), ("Supplier", "Nation"), ("suppkey",), supplier),
        "PLACED": owned("PLACED", "dst", node_id("Customer", c("custkey")), node_id("Order", c("orderkey")), ("Customer", "Order"), ("orderkey",), orders),
        "CONTAINS": contains,
        "SUPPLIES": supplies,
        "DID": owned("DID", "dst", node_id("Customer", c("user_id")), node_id("Event", c("event_id")), ("Customer", "Event"), ("event_id",), ("events",)),
        "NEIGHBOR": neighbor,
        "NEXT": owned("NEXT", "src", node_id("Turn", turn_key()), node_id("Turn", turn_key() + 1), ("Turn", "Turn"), ("conv_id", "turn"), ("conversations",), ("turn",), following),
        "HAS_LABEL": owned("HAS_LABEL", "dst", node_id("Document", c("doc_id")), node_id("Label", c("doc_id")), ("Document", "Label"), ("doc_id",), ("labels",)),
    }
    return Graph(spark, nodes, edges)
