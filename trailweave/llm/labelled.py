"""What the two trained operators share: the bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import whole_text


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text of at most ``per_class`` rows of each label, those with the smallest
    md5 of doc_id; and the number of labelled rows of each class. Null labels and ids don't
    count; where an id has several labels the largest holds. The chosen ids, at most twice
    ``per_class``, are broadcast: texts of other rows aren't moved."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("label IN (0, 1)").collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [known.where(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    spark = docs.sparkSession
    ids = [(r["doc_id"], r["label"]) for part in chosen for r in part.collect()]
    if not ids:
        return docs.select("doc_id", F.lit(0).alias("label"), whole_text().alias("text")).limit(0), counts
    small = spark.createDataFrame(ids, "doc_id long, label int")
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(small), "doc_id").select("doc_id", "label", "text"), counts
