"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words sums, over all subsequences of three characters that both have, a
weight that falls with each character left out, so an insult with gaps or characters
inserted is still near the insult. Landmarks chosen from the vocabulary give a Nyström
feature space in which a squared-hinge machine is trained on labelled sentences: a sentence
is a bag of words, a clean document's are all clean, and of a toxic document the words that
score highest stand for its label, chosen anew in each round.

A kernel with finitely many features lets the landmarks be folded into one weight for each
hashed subsequence: a word's score is a sum over its own subsequences.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import chunked, columns, table, whole_text
from trailweave.llm.labelled import remainder, training_rows

DIM = 1 << 18
DECAY = 0.55  # for each character left out
GAPS = [(a, b) for a in range(1, 5) for b in range(1, 6 - a)]
LANDMARKS = 384
PER_CLASS = 2000  # labelled rows of each class at most that a model learns from
ROUNDS = 4
LONGEST = 256  # characters of a word whose score is kept for later texts
CLEAR = 2.7
LOW = 0.5  # word scores below it tell nothing
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
SPACED = re.compile(r"(?<!\S)(?:\w[.,\-_*]*[ \t]+){2,}\w[.,\-_*]*(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class Generations:
    """A cache of at most twice ``limit`` entries; what is used stays."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def put(self, key: str, value: float) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def promote(self, key: str) -> float | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value


def sentences(text: str) -> list[str]:
    """Pieces that end in a full stop, mark or line break; never empty."""
    return [s for s in SENTENCE.split(text) if s]


def words_of(text: str) -> list[str]:
    """Words in lower case without outer punctuation. Three or more single letters with blanks
    between count as a word too."""
    low = text.lower()
    found = [EDGE.sub("", w) if not (w[0].isalnum() and w[-1].isalnum()) else w for w in low.split()]
    if SPACED.search(low):
        found += [re.sub(r"[\s.,\-_*]+", "", m) for m in SPACED.findall(low)]
    return [w for w in found if w]


def portions(words: list[str], most: int = 1 << 16) -> Iterator[list[str]]:
    """Lists of words with some ``most`` characters together."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, weights and the word of each: three characters of ^word$ with gaps, in
    time linear in the words' lengths but for one sort. Each word has norm 1."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    limit, place = ends[word], np.arange(len(codes))
    features, weights, owners = [], [], []
    for a, b in GAPS:
        ok = np.flatnonzero(place + a + b < limit)
        h = codes[ok] * np.uint64(0x9E3779B97F4A7C15) ^ codes[ok + a] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[ok + a + b] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        features.append((h >> np.uint64(46)).astype(np.int64))
        weights.append(np.full(len(ok), DECAY ** (a + b - 2)))
        owners.append(word[ok])
    # A subsequence that a word has at several places counts once, with the weights added up.
    keys, back = np.unique(np.concatenate(owners) * DIM + np.concatenate(features), return_inverse=True)
    weight = np.bincount(back, weights=np.concatenate(weights), minlength=len(keys))
    owner = keys // DIM
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(words)))
    return keys % DIM, weight / norm[owner], owner


class Model:
    """A weight for each hashed subsequence, a bias, and the map from the highest three word
    scores of a text to a probability."""

    def __init__(self, beta: np.ndarray, bias: float, slopes: np.ndarray, shift: float):
        self.beta, self.bias, self.slopes, self.shift = beta, bias, slopes, shift
        self.cache = Generations(300_000)

    def __getstate__(self):
        return {"beta": self.beta, "bias": self.bias, "slopes": self.slopes, "shift": self.shift}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        feature, weight, owner = subsequences(words)
        return np.bincount(owner, weights=self.beta[feature] * weight, minlength=len(words)) + self.bias

    def margins(self, texts: list[str]) -> list[tuple[list[float], str]]:
        """The scores of the three highest distinct words of each text, and the highest word.
        What a short text lacks counts as LOW."""
        lists = [words_of(t) for t in texts]
        known, fresh = {}, {}
        for words in lists:
            for w in words:
                if w not in known and w not in fresh:
                    value = self.cache.promote(w)
                    if value is None:
                        fresh[w] = None
                    else:
                        known[w] = value
        new = list(fresh)
        for part in portions(new):
            for w, value in zip(part, self.word_scores(part).tolist()):
                known[w] = value
                if len(w) <= LONGEST:
                    self.cache.put(w, value)
        out = []
        for words in lists:
            best = heapq.nlargest(3, ((known[w], w) for w in set(words)))
            out.append(([max(LOW, v) for v, _ in best] + [LOW] * (3 - len(best)), best[0][1] if best else ""))
        return out

    def probability(self, margins) -> np.ndarray:
        x = with_clear(np.asarray(margins, float).reshape(-1, 3))
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes + self.shift, -35, 35)))


def noisy(word: str, rng: np.random.Generator) -> str:
    """The word with a character inserted or doubled, for training."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + str(rng.choice(list(".-*_x") + [word[at - 1]])) + word[at:]


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The normalised subsequence kernel of each word with each of the others."""
    of: dict[int, list[tuple[int, float]]] = {}
    for f, w, o in zip(*(x.tolist() for x in subsequences(others))):
        of.setdefault(f, []).append((o, w))
    out = np.zeros((len(words), len(others)))
    known = np.zeros(DIM, bool)
    known[list(of)] = True
    feature, weight, owner = subsequences(words)
    use = known[feature]
    for f, w, i in zip(feature[use].tolist(), weight[use].tolist(), owner[use].tolist()):
        row = out[i]
        for o, v in of[f]:
            row[o] += w * v
    return out


def train(texts: list[str], y: np.ndarray, seed: int = 8) -> Model:
    rng = np.random.default_rng(seed)
    bags = [sorted({w for s in sentences(t) for w in words_of(s)}) for t in texts]
    df = (Counter(), Counter())
    for bag, label in zip(bags, y):
        df[label].update(bag)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    odds = {w: float(np.log((df[1][w] + 0.1) / (n1 + 0.2)) - np.log((df[0][w] + 0.1) / (n0 + 0.2))) * min(1.0, np.log1p(df[1][w]) / 2) for w in df[1]}
    # Landmarks: words that speak for label 1, and common words, none too near another.
    half = LANDMARKS // 2
    strong = sorted((w for w in odds if df[1][w] > 4 * (df[0][w] + 0.25)), key=lambda w: (-odds[w], w))[: 3 * half]
    common = [w for w, _ in sorted(df[0].items(), key=lambda x: (-x[1], x[0]))[: 6 * half]]
    common = common[:half] + [common[i] for i in sorted(rng.permutation(np.arange(half, len(common)))[:half].tolist())] if len(common) > half else common

    def spread(pool: list[str], most: int) -> list[str]:
        if not pool:
            return []
        k, taken = kernel(pool, pool), []
        for i in range(len(pool)):
            if len(taken) < most and (not taken or k[i, taken].max() < 0.8):
                taken.append(i)
        return [pool[i] for i in taken]

    marks = list(dict.fromkeys(spread(strong, half) + spread(common, half)))
    if not marks:  # no labelled text has a word
        return Model(np.zeros(DIM, np.float32), 0.0, np.zeros(4), float(np.log((n1 + 1) / (n0 + 1))))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^(-1/2): the Nyström features are kernel @ root
    feature, weight, owner = subsequences(marks)
    # Instances: all distinct words of the sample, by their features.
    vocabulary = sorted(set(df[0]) | set(df[1]))
    number = {w: i for i, w in enumerate(vocabulary)}
    clean = np.array([number[w] for w in vocabulary if df[0][w]], np.int64)
    lists = [np.array([number[w] for w in bag], np.int64) for bag in bags]
    score = np.array([odds.get(w, -9.0) for w in vocabulary])
    beta, bias = np.zeros(DIM), 0.0
    hard = np.zeros(0, np.int64)

    def scores(b: np.ndarray, c: float) -> np.ndarray:
        model = Model(b, c, np.ones(4), 0.0)
        return np.concatenate([model.word_scores(part) for part in portions(vocabulary)])

    for _ in range(ROUNDS):
        witness = Counter()
        for words, label in zip(lists, y):
            if label == 1 and len(words):
                top = words[np.argsort(-score[words], kind="stable")[:3]]
                witness.update(top[(score[top] >= max(0.0, score[top[0]] * 0.5)) | (np.arange(len(top)) == 0)].tolist())
        # A word of clean documents can't be what makes one toxic, unless it is far rarer there.
        chosen = [w for w in witness if df[1][vocabulary[w]] > 4 * df[0][vocabulary[w]]]
        negative = np.unique(np.concatenate((rng.permutation(clean)[:6000], hard)))
        negative = negative[~np.isin(negative, chosen)]
        words = [vocabulary[i] for i in chosen]
        extra = [noisy(w, rng) for w in words if len(w) > 3 and df[1][w] >= 3]
        own = [vocabulary[i] for i in negative.tolist()]
        x = kernel([*words, *extra, *own], marks) @ root
        x = np.hstack((x, np.ones((len(x), 1))))
        target = np.concatenate((np.ones(len(words) + len(extra)), -np.ones(len(own))))
        share = np.concatenate(([min(witness[w], 20) for w in chosen], np.full(len(extra), 1.0), np.ones(len(own))))
        # The margin asked for grows with a word's evidence, so that one clear insult suffices.
        asked = np.concatenate(([float(np.clip(odds[w] / 2.5, 1, 3)) for w in words], [float(np.clip(odds[w] / 2.5, 1, 3)) for w in words if len(w) > 3 and df[1][w] >= 3], np.ones(len(own))))
        positive = target > 0
        if positive.any():
            share[positive] /= share[positive].sum()
        share[~positive] /= max(1e-9, share[~positive].sum())
        u, c = np.zeros(x.shape[1]), 2000.0
        ridge = np.eye(x.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(12):  # Newton steps of the squared hinge
            short = target * (x @ u) < asked
            xs = x[short] * (c * share[short])[:, None]
            u = np.linalg.solve(ridge + xs.T @ x[short], xs.T @ (target * asked)[short])
        beta = np.bincount(feature, weights=weight * (root @ u[:-1])[owner], minlength=DIM)
        bias = float(u[-1])
        score = scores(beta, bias)
        hard = np.unique(np.array([w[np.argmax(score[w])] for w, label in zip(lists, y) if label == 0 and len(w)], np.int64)) if (y == 0).any() else hard
    best = np.array([np.maximum(LOW, np.concatenate((np.sort(score[w])[::-1][:3], [LOW] * 3))[:3]) for w in lists])
    slopes, shift = platt(best, y)
    return Model(beta.astype(np.float32), bias, slopes, shift)


def with_clear(x: np.ndarray) -> np.ndarray:
    """The three scores, and how far the first lies above what only clear words reach."""
    return np.column_stack((x, np.maximum(0.0, x[:, 0] - CLEAR) * 5))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic slopes and shift by Newton steps, with a small prior."""
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.hstack((with_clear(x), np.ones((len(x), 1))))
    u = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -35, 35)))
        d = np.maximum(p * (1 - p), 1e-6)
        u -= np.clip(np.linalg.solve((x * d[:, None]).T @ x + 1e-2 * np.eye(len(u)), x.T @ (p - target) + 1e-2 * u), -1, 1)
    return u[:-1], float(u[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """A model from the labelled rows that aren't held out; the smoothed share of label 1 where
    a class has no row. The sample, at most twice ``per_class`` texts cut to their distinct
    words, comes to the driver."""
    rows, counts = training_rows(docs, labels, "toxic", remainder(5) != 0, per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, 500):
            ids, label, texts = columns(batch, "doc_id", "label", "text")
            bags = ["\n".join(sorted({w for s in sentences(t) for w in words_of(s)})) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(bags, pa.string())], names=["doc_id", "label", "text"])

    got = rows.mapInArrow(distinct, "doc_id long, label int, text string").toArrow().sort_by("doc_id")
    return train(got.column("text").to_pylist(), np.array(got.column("label").to_pylist()))


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.string())])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the word that scores highest) for every
    row of ``docs(doc_id, text)``.

    Labels are learnt from rows whose crc32 of doc_id modulo 5 isn't 0, PER_CLASS of each
    label at most. Null texts count as empty, and empty texts have a low score; null and
    repeated ids are scored row by row; other columns are ignored."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, 1000):
            ids, texts = columns(batch, "doc_id", "text")
            if isinstance(model, float):
                got, words = [model] * len(ids), [""] * len(ids)
            else:
                best = model.margins(texts)
                got, words = model.probability([m for m, _ in best]), [w for _, w in best]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.float64()), pa.array(words, pa.string())], schema=RESULT)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double, evidence string")
    return own.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
