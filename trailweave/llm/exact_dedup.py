"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut into chunks whose ends depend on what stands there, so equal passages cut
alike wherever they lie. Chunk digests become verified identifiers: each distinct chunk is
moved once, after partial aggregation, to prove that its digest stands for one content.
From then on documents are compared by their ordered identifier lists, a few dozen bytes a
page, and long texts aren't moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import compact, free_name, materialise, table, whole_text

#: From 1024 code points to the next sentence or line end, or 8192 where none comes.
CHUNK = r"(?s).{1024,8191}?[.\n]|.{1,8192}"


def chunks(text: Column) -> Column:
    """The chunks in order; put together they are the text. Empty text: no chunk."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def colliding(docs: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk (none is known for this hash)."""
    one = docs.select(F.explode(chunks(whole_text())).alias("chunk")).withColumn("id", digest(F.col("chunk")))
    sides = one.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return sides.where(F.col("low") != F.col("high")).select("id")


def recipes(docs: DataFrame) -> DataFrame:
    """row (a number of its own for every row), doc_id, ids (ordered identifiers of chunks),
    text_sha256; written once, so that nothing after it reads a text. If a digest ever stood
    for two chunks, every identifier gets a second, independent digest."""
    identifier = digest
    if colliding(docs).limit(1).count():
        def identifier(c: Column) -> Column:
            return F.concat(digest(c), F.unhex(F.sha2(F.reverse(c), 512)))
    text = whole_text()
    made = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(chunks(text), identifier).alias("ids"), F.sha2(text, 256).alias("text_sha256"))
    return materialise(compact(made, docs), "recipes")


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts the
    row with the largest doc_id stays (keep="min": the smallest); null ids are smallest. Just
    one row of a group has ``kept``: where that doc_id repeats, the last as the table was
    read. Other columns are ignored; an empty table gives an empty result. Groups are summed
    before the shuffle; those of more than one row are written, and the join back with them
    is one that adaptive execution splits where a group is hot.
    """
    own = recipes(docs)
    pick = F.max if keep == "max" else F.min
    groups = own.groupBy("ids").agg(pick(F.struct("doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialise(groups.select("ids", F.col("head.doc_id").alias("keep_id"), F.col("head.row").alias("keep_row"), "group_size"), "equal-texts")
    alone = F.col("keep_row").isNull()
    return own.join(groups, "ids", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one row stays: that with the largest doc_id.

    The rows to drop are named by doc_id and text digest, so a repeated doc_id with another
    text stays; of rows equal in both, one stays. A row that stays has its own doc_id as
    keep_id, so only rows that aren't kept are written.
    """
    digest_name = free_name(docs, "digest__")
    keep_name, group_name = free_name(docs, "keep__"), free_name(docs, "group__")
    groups = materialise(compact(exact_groups(docs).where(~F.col("kept")), docs), "exact-groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(keep_name), F.col("text_sha256").alias(group_name)).distinct()
    own = docs.withColumn(digest_name, F.sha2(whole_text(), 256))
    left = own.join(gone, F.col("doc_id").eqNullSafe(F.col(keep_name)) & (F.col(digest_name) == F.col(group_name)), "left_anti")
    if groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count():
        left = left.dropDuplicates(["doc_id", digest_name])
    return left.select(*docs.columns)
