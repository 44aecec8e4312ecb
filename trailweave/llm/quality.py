"""Quality by a factorisation machine.

Inputs are hashed words, statistics of structure in steps, and the text's length as its only
metadata. Pairwise interactions have rank ``RANK``; by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
a score costs time linear in the inputs that aren't zero.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import words
from trailweave.llm.common import chunked, columns, free_name, table, whole_text
from trailweave.llm.labelled import remainder, training_rows

WORDS = 1 << 14
STEPS = 12
RANK = 8
PER_CLASS = 2000  # labelled rows of each class at most that a model learns from


def _class(code: int) -> int:
    c = chr(code)
    if c == "\n":
        return 0
    if c.isspace():
        return 1
    if c.isdigit():
        return 2
    if c.isupper():
        return 3
    if c.isalpha():
        return 4
    if c in ".,;:'\"()-?":
        return 5
    if c == "!":
        return 6
    if c == "|":
        return 7
    return 8 if unicodedata.category(c)[0] in "PS" else 9


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([_class(i) if not 0xD800 <= i < 0xE000 else 9 for i in range(1 << 16)], np.uint8)


def statistics(text: str, hashes: np.ndarray) -> list[float]:
    """Shares and rates, each between 0 and 1, of a text and its words' hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = max(1, len(codes))
    shares = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=10) / n
    count = max(1, len(hashes))
    repeats = distinct = top = 0.0
    if len(hashes):
        repeats = float((hashes[1:] == hashes[:-1]).sum()) / count
        _, sizes = np.unique(hashes, return_counts=True)
        distinct, top = len(sizes) / count, float(sizes.max()) / count
    lines = text.split("\n")
    return [*shares.tolist(), repeats, distinct, top, min(1.0, np.log1p(len(hashes)) / 12), min(1.0, n / count / 30), 1 - len(set(lines)) / len(lines), min(1.0, text.count(".") / count), min(1.0, np.log1p(n) / 16)]


N_STATS = 18
SIZE = WORDS + N_STATS * STEPS


def inputs(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: indices, values, and the start of each row. No row is empty."""
    held = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    found, bounds = words.hashes(pc.utf8_lower(held))
    found = (found >> np.uint64(1)).astype(np.int64)
    edges = bounds.tolist()
    stats = [statistics(text, found[a:b]) for text, a, b in zip(held.to_pylist(), edges[:-1], edges[1:])]
    row, place = np.repeat(np.arange(len(held)), np.diff(bounds)), found % WORDS
    n = len(held)
    keys, counts = np.unique(row * SIZE + place, return_counts=True)
    tf = np.log1p(counts)
    norm = np.sqrt(np.bincount(keys // SIZE, weights=tf * tf, minlength=n))
    values = tf / np.maximum(norm[keys // SIZE], 1e-9) * 0.5
    s = np.array(stats).reshape(n, N_STATS)
    step = np.minimum((np.sqrt(s) * STEPS).astype(np.int64), STEPS - 1)
    own = np.arange(n)[:, None] * SIZE + WORDS + np.arange(N_STATS) * STEPS + step
    keys = np.concatenate((keys, own.ravel()))
    values = np.concatenate((values, np.full(own.size, 0.5)))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.searchsorted(keys, np.arange(n) * SIZE)
    return keys % SIZE, values, starts


class Machine:
    """A factorisation machine with logistic output."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def scores(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*rows)[0], -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, seed: int = 5) -> Machine:
    """AdaGrad over small batches; classes weigh alike."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    gw, gv, g0 = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for batch in np.array_split(order, max(1, len(y) // 32)):
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            lengths = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            margin, sums = model.margins(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y[batch]) * weight[batch] / len(batch)
            each = np.repeat(error, lengths)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, weights=each * value, minlength=len(used)) + decay * model.w[used]
            part = (each * value)[:, None] * (np.repeat(sums, lengths, axis=0) - model.v[index] * value[:, None])
            dv = np.stack([np.bincount(back, weights=part[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + decay * model.v[used]
            d0 = error.sum()
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w0 -= rate * d0 / np.sqrt(g0)
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | float:
    """A machine from the labelled rows that aren't held out; the share of label 1, smoothed,
    where a class has no row."""
    rows, counts = training_rows(docs, labels, "quality", remainder(3) != 1, per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, 500):
            ids, label, texts = columns(batch, "doc_id", "label", "text")
            index, value, starts = inputs(texts)
            ends = [*starts[1:].tolist(), len(index)]
            out = [(i, y, index[a:b].tolist(), value[a:b].tolist()) for i, y, a, b in zip(ids, label, starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())))], names=["doc_id", "label", "place", "value"])

    got = rows.mapInArrow(features, "doc_id long, label int, place array<int>, value array<float>").toArrow().sort_by("doc_id")
    place, value, y = (got.column(c).to_pylist() for c in ("place", "value", "label"))
    if len(set(y)) < 2:  # labels of documents that aren't there
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return train([(np.array(i, np.int64), np.array(v)) for i, v in zip(place, value)], np.array(y))


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Machine | float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, and behind them a score between 0 and 1 under a name that
    docs doesn't have, ``score__`` if free; null text is empty text."""
    fields = [docs.schema[c] for c in keep]
    score_name, text_name = free_name(docs, "score__"), free_name(docs, "text__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.slices(batch.column(batch.num_columns - 1)):
                got = np.full(len(texts), model) if isinstance(model, float) else model.scores(*inputs(texts))
                held = [batch.column(k).slice(first, len(texts)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(got, pa.float64())], names=[*keep, score_name])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(score_name, T.DoubleType())])
    return docs.select(*keep, whole_text().alias(text_name)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``.

    Labels are learnt from rows whose crc32 of doc_id modulo 3 isn't 1, PER_CLASS of each
    label at most. Null texts count as empty, and empty texts have a score too; null and
    repeated ids are scored row by row; other columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(own, fit(docs, labels)).select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("score__").alias("score"), (F.col("score__") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; the others go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = scored(docs, model, tuple(docs.columns))
    return found.where(F.col(found.columns[-1]) >= 0.5).select(*docs.columns)
