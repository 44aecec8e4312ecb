"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Weights run down a tree of domains, languages and sources. Every node can take at most what
its leaves hold over all epochs. Top down, a node's budget is shared among its children by
weight; what a child can't take goes to its siblings, and because a node is never given more
than its subtree can hold, only what no sibling can take goes to the ancestor's other
children. Each leaf then takes a token prefix of seeded epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.llm.common import free_name, materialise, table, whole_text

LEVELS = ("domain", "lang", "source")
BUCKETS = 4096  # of a leaf's order in an epoch; each is sorted by itself


def n_tokens(text: Column) -> Column:
    """Blank-separated tokens; empty text has none."""
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def domain_of(source: Column) -> Column:
    """The source's domain: by the last digit of its name (0-4 web, 5-7 books, 8 and 9 code)."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin("5", "6", "7"), "books").when(last.isin("8", "9"), "code").otherwise("web")


def weight_of(domain: Column) -> Column:
    return F.when(domain == "web", 0.5).when(domain == "books", 0.3).otherwise(0.2)


def share(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Water filling among siblings: adds ``given``, from columns weight, capacity and budget
    (the parent's). A node is full if the siblings that fill up no later, and the weights of
    the others at its level, need no more than the budget."""
    nodes = nodes.withColumn("fill", F.col("capacity") / F.col("weight"))
    level = Window.partitionBy(*parent).orderBy("fill").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(*parent)
    nodes = nodes.withColumn("below", F.sum("capacity").over(level)).withColumn("rest", F.sum("weight").over(all_) - F.sum("weight").over(level))
    nodes = nodes.withColumn("full", F.col("below") + F.col("fill") * F.col("rest") <= F.col(budget) * (1 + 1e-12))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(all_)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_)
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * (F.col(budget) - taken) / open_)
    return nodes.withColumn("given", given).drop("fill", "below", "rest", "full")


def leaf_budgets(leaves: DataFrame, fraction: float, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with ``budget``: a whole number of tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("own")).withColumn("weight", weight_of(F.col("domain"))).withColumn("one", F.lit(1))
    domains = domains.withColumn("b0", F.sum("own").over(Window.partitionBy("one")) * F.lit(fraction))
    domains = share(domains, ["one"], "b0").select("domain", F.col("given").alias("b1"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", F.lit(1.0))
    langs = share(langs.join(domains, "domain"), ["domain"], "b1").select("domain", "lang", F.col("given").alias("b2"))
    own = share(leaves.withColumn("weight", F.lit(1.0)).join(langs, ["domain", "lang"]), ["domain", "lang"], "b2")
    return own.select(*LEVELS, "tokens", F.floor(F.round("given", 3)).cast("long").alias("budget"))


def mix(docs: DataFrame, fraction: float = 1.0, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """One row per document and epoch chosen: doc_id, domain, lang, source, epoch, start (the
    leaf's tokens before it), n_tokens, taken (fewer than n_tokens at the leaf's end only).

    ``docs`` has doc_id, text, lang, source; null lang or source is the leaf "", null text
    and empty text have no tokens and are never chosen. The budget is ``fraction`` of all
    tokens. Equal doc_ids are ordered by text digest; rows equal in both take part each, in
    either order. Other columns are ignored. An empty table gives an empty result. Leaf
    order within an epoch is by md5 of seed, epoch and doc_id, sorted by buckets of equal
    md5 prefix whose token sums are added up first, so a hot leaf is never one task's.
    """
    return _mixed(docs, fraction, max_epochs, seed).drop("tie")


def _mixed(docs: DataFrame, fraction: float, max_epochs: int, seed: int) -> DataFrame:
    text = whole_text()
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(text).alias("n_tokens"), F.md5(text).alias("tie"))
    base = materialise(base.where("n_tokens > 0").withColumn("domain", domain_of(F.col("source"))), "mix-lengths")
    leaves = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    # One row a leaf; the plan is cut here because every later step reads it.
    budgets = materialise(leaf_budgets(leaves, fraction, max_epochs).where("budget > 0"), "mix-budgets")
    sides = base.join(budgets, list(LEVELS))
    epochs = F.sequence(F.lit(0), F.least(F.floor((F.col("budget") - 1) / F.col("tokens")), F.lit(max_epochs - 1)).cast("int"))
    drawn = sides.withColumn("epoch", F.explode(epochs))
    drawn = drawn.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    drawn = drawn.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    group = [*LEVELS, "epoch"]
    sums = drawn.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy(*group, "bucket").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, [*group, "bucket"])
    start = (F.col("epoch") * F.col("tokens") + F.col("bucket_start") + F.col("inner")).cast("long")
    placed = placed.withColumn("start", start).where(F.col("start") < F.col("budget"))
    return placed.select("doc_id", *LEVELS, F.col("epoch").cast("int").alias("epoch"), "start", "n_tokens", F.least(F.col("n_tokens"), F.col("budget") - F.col("start")).alias("taken"), "tie")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_share(level: str, source: str, parent: str, budget: str) -> str:
    return f"""
{level}_f AS (SELECT *, capacity / weight AS fill FROM {source}),
{level}_l AS (SELECT *, sum(capacity) OVER (PARTITION BY {parent} ORDER BY fill RANGE UNBOUNDED PRECEDING) AS below,
  sum(weight) OVER (PARTITION BY {parent}) - sum(weight) OVER (PARTITION BY {parent} ORDER BY fill RANGE UNBOUNDED PRECEDING) AS rest FROM {level}_f),
{level}_s AS (SELECT *, below + fill * rest <= {budget} * (1 + 1e-12) AS is_full FROM {level}_l),
{level} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE weight * ({budget} - sum(CASE WHEN is_full THEN capacity ELSE 0.0::DOUBLE END) OVER (PARTITION BY {parent}))
  / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER (PARTITION BY {parent}) END AS given FROM {level}_s)"""


def mix_sql(docs: str = "documents", fraction: float = 1.0, max_epochs: int = 4, seed: int = 7) -> str:
    """The same in one statement, for the check; ends in a SELECT from ``mixed``."""
    return f"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  (length(text) - length(replace(text, ' ', '')) + 1)::BIGINT AS n_tokens, md5(text) AS tie,
  CASE WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' WHEN right(source, 1) IN ('8', '9') THEN 'code' ELSE 'web' END AS domain
  FROM {docs} WHERE text <> ''),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {max_epochs} AS capacity FROM base GROUP BY ALL),
d0 AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'books' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS weight,
  (SELECT sum(tokens) * {fraction}::DOUBLE FROM leaves) AS b0 FROM leaves GROUP BY domain),
{_sql_share("d", "d0", "1", "b0")},
l0 AS (SELECT domain, lang, sum(leaves.capacity) AS capacity, 1.0::DOUBLE AS weight, any_value(d.given) AS b1 FROM leaves JOIN d USING (domain) GROUP BY domain, lang),
{_sql_share("l", "l0", "domain", "b1")},
s0 AS (SELECT domain, lang, source, tokens, leaves.capacity, 1.0::DOUBLE AS weight, l.given AS b2 FROM leaves JOIN l USING (domain, lang)),
{_sql_share("s", "s0", "domain, lang", "b2")},
budgets AS (SELECT domain, lang, source, tokens, floor(round(given, 3))::BIGINT AS budget FROM s),
drawn AS (SELECT base.*, tokens, budget, epoch, md5(concat_ws(':', '{seed}', epoch, doc_id)) AS place
  FROM base JOIN budgets USING (domain, lang, source), range({max_epochs}) AS e(epoch) WHERE epoch * tokens < budget),
placed AS (SELECT *, (epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id, tie
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM drawn),
mixed AS (SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, start, n_tokens, least(n_tokens, budget - start) AS taken FROM placed WHERE start < budget)
SELECT * FROM mixed
"""


OP2_SQL = mix_sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with the parameters of ``op2``: as many tokens as there are, of which each
    domain has its target share as far as four epochs allow. A row is repeated for each epoch
    that draws it; the last document of a leaf stays whole. Texts without tokens aren't drawn.
    Rows are named by doc_id and text; those equal in both are drawn together."""
    name, digest, times, tie = (free_name(docs, n) for n in ("drawn__", "digest__", "times__", "tie__"))
    drawn = _mixed(docs, 1.0, 4, 7).groupBy(F.col("doc_id").alias(name), F.col("tie").alias(tie)).agg(F.countDistinct("epoch").cast("int").alias(times))
    own = docs.where(n_tokens(whole_text()) > 0).withColumn(digest, F.md5(whole_text()))
    own = own.join(drawn, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(tie)))
    return own.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
