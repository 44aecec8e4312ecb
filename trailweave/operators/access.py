"""Operators that no query text reaches, as functions over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.sources.graph import Graph


def edge_scan(graph: Graph, label: str | None = None, props: set[str] | None = None) -> DataFrame:
    """All edges of a label, or of all labels: eid, src, dst, directed and properties."""
    return graph.edges(label, props)


def node_by_id(graph: Graph, ids: DataFrame, column: str = "id", label: str | None = None) -> DataFrame:
    """The nodes whose ids a column holds; missing ones give no row. A semi-join, so one id or
    a billion take the same plan."""
    return graph.nodes(label).join(ids.select(F.col(column).alias("wanted__")).distinct(), F.col("id") == F.col("wanted__"), "left_semi")


def edge_by_id(graph: Graph, ids: DataFrame, column: str = "eid", label: str | None = None) -> DataFrame:
    """The edges whose ids a column holds."""
    return graph.edges(label).join(ids.select(F.col(column).alias("wanted__")).distinct(), F.col("eid") == F.col("wanted__"), "left_semi")


def project_endpoints(graph: Graph, rows: DataFrame, column: str = "eid", label: str | None = None) -> DataFrame:
    """Rows with ``start`` and ``end`` of the edge in a column; rows of missing edges go."""
    ends = graph.edges(label, set()).select(F.col("eid").alias("edge__"), F.col("src").alias("start"), F.col("dst").alias("end"))
    return rows.join(ends, rows[column] == ends["edge__"]).drop("edge__")


def empty_result(rows: DataFrame) -> DataFrame:
    """Run the rows for their effect and return none of them."""
    rows.write.format("noop").mode("overwrite").save()
    return rows.limit(0)
