import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, and near copies."""
    rnd = random.Random(9)
    base = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(90)) for _ in range(200))
    near = base.split()
    near[50] = "changed"
    texts = [
        (0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, "short"), (6, "short"), (7, "short"), (7, "another text with the same id"),
        (None, "no id"), (None, base), (None, None), (8, "x" * 200_000), (9, "word " * 60_000), (10, "a\u0301 \u00e9 \x00 \x1c\u3000\ud7ff <|endoftext|> \U0001f600"), (11, base + " tail"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("ids", "key", "label", "start", "digest", "kept", "class_id", "row", "score", "score__", "token", "tie", "codes", "keep_id", "group_size", "epoch", "bucket", "text__x"):
        out = out.withColumn(name, F.lit("extra"))
    return out


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, None, None), (None, 1, 1), (5, 1, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
