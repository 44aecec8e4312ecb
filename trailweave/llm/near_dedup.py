"""Near-duplicate classes by SimHash and an LSH forest, verified exactly.

Texts with equal sets of five-word shingles are one node. Each node has a 128-bit SimHash, and
each trie of the forest orders the nodes by another permutation of its bits. The depth of a
prefix follows the density around a node: at the deepest level that its crowd asks for, and
from there the node climbs to shorter prefixes until the tries of that level meet the target
recall at similarity 0.8. Seen from the root: all nodes take part at the first level; those
of a prefix that more than ``CAP`` share go on to prefixes six bits deeper with as many more
tries as the recall needs there. Crowds that are left at the last level are dealt to blocks,
and every two blocks are compared. So every node is at a level whose tries meet the recall.

Pairs of a bucket whose signatures are near enough are verified by the Jaccard similarity of
their shingles; verified links are joined into classes. In a bucket with a dense cluster not
all pairs are made: every member is first linked to a leader. Once those links are verified,
a second pass takes the members of such buckets that have a near neighbour in another class,
with their shingles, and compares them inside the bucket until no similar pair of different
classes is left. The rows that Spark moves follow the number of members, not of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import words
from trailweave.llm.common import chunked, columns, compact, free_name, materialise, partition_id, table, whole_text
from trailweave.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.97
BITS = 128
CAP = 8192  # nodes of a bucket; the nodes of a fuller prefix go deeper
LEVELS = 3
STEP = 6
SHORT = 5  # shingles of a node whose bits differ more
SPARSE = 1  # pairs per node up to which a bucket gives all its pairs
BLOCK_BYTES = 16 << 20  # of shingles that a task compares at once

_spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
_column = np.arange(16) * 256


def shingle_sets_of(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each text, of lower-case words
    between white space. A shorter text is one shingle; a text without words has none."""
    h, bounds = words.hashes(pc.utf8_lower(texts))

    def mixed(width: int, h: np.ndarray) -> np.ndarray:
        n = len(h) - width + 1
        mix = np.full(n, width, np.uint64)
        for k in range(width):
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            mix ^= mix >> np.uint64(31)
        return words.finish(mix)

    whole = mixed(SHINGLE, h) if len(h) >= SHINGLE else h
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(np.unique(whole[a : b - SHINGLE + 1]) if b - a >= SHINGLE else mixed(b - a, h[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def shingles(text: str) -> np.ndarray:
    return shingle_sets_of(pa.array([text], pa.string()))[0]


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, each the majority of a bit over all shingles, as two signed 64-bit integers."""
    if not len(hashes):
        return 0, 0
    both = np.stack((hashes, words.finish(hashes + np.uint64(0x632BE59BD9B4E019))), axis=1)
    counts = np.bincount((both.view(np.uint8).reshape(len(hashes), 16) + _column).ravel(), minlength=4096).reshape(16, 256)
    ones = (counts.astype(np.float32) @ _spread).ravel()
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)
    return int(packed[0]), int(packed[1])


#: The share of bits in which two sets of similarity 0.8 differ, at worst: by exact binomials
#: for unions of up to SHORT shingles, and of more (15 against 12 is the worst of these; many
#: shingles tend to arccos(8/9)/pi = 0.1514).
APART_SHORT, APART = 0.1875, 0.1611


def tries_for(depth: int, apart: float) -> int:
    """Tries of that depth by which a pair at the least similarity is met with the recall."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - apart) ** depth))


def plan(nodes: int) -> list[tuple[int, int, int]]:
    """Depth, tries, and tries of short nodes at each level. The first depth leaves about a
    thousand nodes to a prefix."""
    first = min(24, max(8, math.ceil(math.log2(max(1, nodes) / 1024))))
    return [(d, tries_for(d, APART), tries_for(d, APART_SHORT)) for d in range(first, first + LEVELS * STEP, STEP)]


def reach(apart: float) -> int:
    """The most signature bits that a pair at the least similarity differs in, but for one in a
    thousand."""
    return math.floor(apart * BITS + 3.2 * math.sqrt(apart * (1 - apart) * BITS))


CUTS = (reach(APART_SHORT), reach(APART))


NODE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.string()), ("key", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64()), ("size", pa.int32())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row: row (a number of its own), doc_id, tie (md5 of the text), key (of the
    shingle set), the signature's halves s0 and s1, size (of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = partition_id() << 40
        for batch in batches:
            for first, texts in words.slices(batch.column(2)):
                sets = shingle_sets_of(texts)
                halves = [signature(own) for own in sets]
                own = [np.arange(row, row + len(sets)), batch.column(0).slice(first, len(sets)), batch.column(1).slice(first, len(sets)), [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [h[0] for h in halves], [h[1] for h in halves], [len(x) for x in sets]]
                row += len(sets)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(own, NODE)], schema=NODE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text()).alias("tie"), whole_text().alias("text")).mapInArrow(run, "row long, doc_id long, tie string, key binary, s0 long, s1 long, size int")


def forest(nodes: DataFrame, tries: int, short_tries: int, depth: int, seed: int = 3) -> DataFrame:
    """A row for each node and trie: trie, prefix (the first ``depth`` permuted bits), key, s0,
    s1, size. Nodes with more than SHORT shingles are in the first ``tries`` only."""
    orders = np.stack([np.random.default_rng([seed, t]).permutation(BITS)[:depth] for t in range(max(tries, short_tries))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(depth - 1, -1, -1, dtype=np.int64)
        for batch in chunked(batches, 2000):
            halves = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1).astype("<i8")
            bits = np.unpackbits(halves.view(np.uint8).reshape(len(halves), 16), axis=1, bitorder="little")
            codes = np.stack([bits[:, order].astype(np.int64) @ weights for order in orders], axis=1)
            own = np.where(batch.column(3).to_numpy(zero_copy_only=False) <= SHORT, max(tries, short_tries), tries)
            use = np.arange(codes.shape[1]) < own[:, None]
            at = pa.array(np.repeat(np.arange(len(codes)), own))
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(use)[1].astype(np.int32)), pa.array(codes[use]), *(batch.column(k).take(at) for k in range(4))], names=["trie", "prefix", "key", "s0", "s1", "size"])

    return nodes.select("key", "s0", "s1", "size").mapInArrow(run, "trie int, prefix long, key binary, s0 long, s1 long, size int")


BUCKET = ["level", "trie", "prefix", "salt"]


def blocks(rows: DataFrame, group: list[str], weight: DataFrame, cap: int) -> DataFrame:
    """rows of the groups in ``weight(*group, w)``, w over ``cap``, dealt by key to blocks of
    half a cap; every two blocks of a group have a ``salt`` of their own, so that any two rows
    of a group meet, for rows that grow with w over ``cap``."""
    own = rows.join(weight, group).withColumn("n", F.ceil(F.col("w") * 2 / cap)).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("other <> block")
    return own.withColumn("salt", F.least("block", "other") * F.col("n") + F.greatest("block", "other") + 1).drop("w", "n", "block", "other")


def buckets(nodes: DataFrame, levels: list[tuple[int, int, int]], cap: int = CAP) -> DataFrame:
    """level, trie, prefix, salt, key, s0, s1, size: the buckets in which nodes meet."""
    out = None
    for level, (depth, tries, short_tries) in enumerate(levels):
        trees = forest(nodes, tries, short_tries, depth).withColumn("level", F.lit(level))
        rows = materialise(trees, "forest")
        crowded = materialise(rows.groupBy("level", "trie", "prefix").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > cap), "crowded")
        full = crowded.limit(1).count() > 0
        even = (rows.join(crowded, ["level", "trie", "prefix"], "left_anti") if full else rows).withColumn("salt", F.lit(0).cast("long"))
        out = even if out is None else out.unionByName(even)
        if not full:
            return out
        if level + 1 < len(levels):
            deeper = rows.join(crowded, ["level", "trie", "prefix"], "left_semi").select("key").distinct()
            nodes = materialise(nodes.join(deeper, "key", "left_semi"), "deeper")
    return out.unionByName(blocks(rows, ["level", "trie", "prefix"], crowded, cap))


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of one group at a time, as slices of the batches that hold them."""
    name, held = None, []
    for batch in batches:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
        change = np.ones(batch.num_rows, bool)
        if batch.num_rows:
            change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cuts = np.flatnonzero(change).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            own = tuple(int(k[a]) for k in keys)
            if own != name:
                if held:
                    yield name, held
                name, held = own, []
            held.append(batch.slice(a, b - a))
    if held:
        yield name, held


class Near:
    """Signatures of a bucket, compared by rows."""

    def __init__(self, parts: list[pa.RecordBatch], cuts: tuple[int, int], at: int = 5):
        get = lambda k: np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])
        self.halves = np.stack((get(at), get(at + 1)), axis=1).astype(np.int64).view(np.uint64)
        self.reach = np.where(get(at + 2) <= SHORT, *cuts).astype(np.uint8)

    def rows(self, start: int, stop: int, behind: int = 0) -> np.ndarray:
        """Whether each of the nodes from start to stop is near each node from ``behind`` on."""
        one, two = self.halves[start:stop], self.halves[behind:]
        apart = np.bitwise_count(one[:, None, 0] ^ two[None, :, 0]) + np.bitwise_count(one[:, None, 1] ^ two[None, :, 1])
        return apart <= np.maximum(self.reach[start:stop, None], self.reach[None, behind:])

    def stripes(self) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, (1 << 20) // max(1, len(self.halves)))
        for start in range(0, len(self.halves), step):
            yield start, self.rows(start, min(start + step, len(self.halves)))


def star(near: Near) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of near nodes, and whether the bucket is dense and has stars in place of all pairs."""
    n, found, count = len(near.halves), [], 0
    for start, part in near.stripes():
        i, j = np.nonzero(part)
        up = j > i + start
        found.append((i[up] + start, j[up]))
        count += int(up.sum())
        if count > SPARSE * n:
            break
    else:
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), False
    left, leads, members = np.ones(n, bool), [], []
    for lead in range(n):
        if left[lead]:
            left[lead] = False
            own = np.flatnonzero(near.rows(lead, lead + 1, lead)[0] & left[lead:]) + lead
            left[own] = False
            leads.append(np.full(len(own), lead))
            members.append(own)
    return np.concatenate(leads), np.concatenate(members), True


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary()), *((n, pa.int64()) for n in BUCKET)])


def bucket_pairs(rows: DataFrame, cuts: tuple[int, int] = CUTS) -> DataFrame:
    """Pairs (a, b), a < b, of near nodes of a bucket. Dense buckets give stars, and a row with
    null a that names the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for name, parts in grouped(batches, BUCKET):
            if sum(p.num_rows for p in parts) < 2:
                continue
            keys = pa.concat_arrays([p.column(4) for p in parts])  # in order, so a < b
            i, j, dense = star(Near(parts, cuts))
            a, b = keys.take(pa.array(i)), keys.take(pa.array(j))
            if dense:
                a, b = (pa.concat_arrays([x, pa.nulls(1, pa.binary())]) for x in (a, b))
            if len(a):
                out.append(pa.RecordBatch.from_arrays([a, b, *(pa.array(np.full(len(a), x, np.int64)) for x in name)], schema=PAIR))
                size += len(a)
            if size > 10_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    dealt = rows.select(*BUCKET, "key", "s0", "s1", "size").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "key")
    return dealt.mapInArrow(run, "a binary, b binary, level long, trie long, prefix long, salt long")


def open_nodes(rows: DataFrame, cuts: tuple[int, int] = CUTS) -> DataFrame:
    """The bucket and key of the nodes that have a near one with another ``label`` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in grouped(batches, BUCKET):
            labels = pa.concat_arrays([p.column(8) for p in parts]).dictionary_encode()
            if len(labels.dictionary) < 2:
                continue
            code = labels.indices.to_numpy(zero_copy_only=False)
            used = np.concatenate([(part & (code[start : start + len(part), None] != code[None, :])).any(axis=1) for start, part in Near(parts, cuts).stripes()])
            keys = pa.concat_arrays([p.column(4) for p in parts]).filter(pa.array(used))
            if len(keys):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), x, np.int64)) for x in name), keys], names=[*BUCKET, "key"])

    dealt = rows.select(*BUCKET, "key", "s0", "s1", "size", "label").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "key")
    return dealt.mapInArrow(run, "level long, trie long, prefix long, salt long, key binary")


def joined(near: Near, keys: list[bytes], labels: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
    """Verified pairs that join the classes of near nodes. Each node is compared with all
    near ones of other classes at once: its shingles are flagged, and the flags that each of
    the others meets are counted."""
    above = {x: x for x in labels}

    def find(x: bytes) -> bytes:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    places, flags = places.astype(np.int32), np.zeros(len(distinct), bool)
    for i in range(len(keys) - 1):
        own = find(labels[i])
        others = [j for j in (np.flatnonzero(near.rows(i, i + 1, i + 1)[0]) + i + 1).tolist() if find(labels[j]) != own and sizes[j]]
        if not others or not sizes[i]:
            continue
        mine = places[ends[i] - sizes[i] : ends[i]]
        flags[mine] = True
        for at in range(0, len(others), 256):
            some = np.array(others[at : at + 256])
            stops = np.cumsum(sizes[some])
            which = np.repeat(ends[some] - stops, sizes[some]) + np.arange(stops[-1])
            both = np.add.reduceat(flags[places[which]], stops - sizes[some], dtype=np.int64)
            for j in some[both >= SIMILARITY * (sizes[i] + sizes[some] - both)].tolist():
                x, y = find(labels[i]), find(labels[j])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    yield keys[i], keys[j]
        flags[mine] = False


def bucket_links(rows: DataFrame, cuts: tuple[int, int] = CUTS) -> DataFrame:
    """Verified pairs (a, b) that join the classes of a bucket's nodes (key, s0, s1, size,
    label, items): no similar pair of near nodes is left in different classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches, BUCKET):
            keys, labels = (pa.concat_arrays([p.column(k) for p in parts]).to_pylist() for k in (4, 8))
            if len(set(labels)) > 1:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for p in parts for x in p.column(9)]
                found = list(joined(Near(parts, cuts), keys, labels, sets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select(*BUCKET, "key", "s0", "s1", "size", "label", "items").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "key")
    return dealt.mapInArrow(run, "a binary, b binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def shingle_sets(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, items (the sorted shingles, as bytes) of the nodes with these keys: only their texts
    are read, one row a node."""
    wanted = nodes.join(keys, "key", "left_semi").select("doc_id", "tie", "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([s.tobytes() for s in shingle_sets_of(texts)], pa.binary())], names=["key", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text()).alias("tie"), whole_text().alias("text"))
    both = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["tie"] == wanted["tie"])
    joined_ = texts.join(wanted.hint("merge"), both).select("key", "text")
    return materialise(joined_.mapInArrow(sets, "key binary, items binary").dropDuplicates(["key"]), "shingle-sets")


def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            use = pa.array([similar(*(np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x, y))) for k in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(use) for k in (0, 1)], names=["a", "b"])

    one, two = items.select(F.col("key").alias("a"), F.col("items").alias("x")), items.select(F.col("key").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def links(docs: DataFrame, cap: int = CAP, block_bytes: int = BLOCK_BYTES, cuts: tuple[int, int] = CUTS) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and node, label for the nodes that have a verified link."""
    prints = materialise(compact(fingerprints(docs), docs), "fingerprints")
    first = F.min(F.struct("doc_id", "tie"))
    nodes = prints.groupBy("key").agg(first.alias("one"), F.min("s0").alias("s0"), F.min("s1").alias("s1"), F.min("size").alias("size"))
    nodes = materialise(nodes.select("key", "one.doc_id", "one.tie", "s0", "s1", "size"), "nodes")
    rows = buckets(nodes, plan(nodes.count()), cap)
    found = materialise(compact(bucket_pairs(rows, cuts), docs), "pairs")
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    items = shingle_sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), nodes, docs)
    edges = materialise(compact(verified(pairs, items), docs), "links")
    labels = components(edges)
    dense = found.where("a IS NULL").select(*BUCKET).distinct()
    if dense.limit(1).count():
        own = labels.withColumnRenamed("node", "key")

        def labelled(df: DataFrame) -> DataFrame:
            return df.join(own, "key", "left").withColumn("label", F.coalesce("label", "key"))

        open_ = materialise(open_nodes(labelled(rows.join(dense, BUCKET, "left_semi")), cuts), "open")
        if open_.limit(1).count():
            # A node whose near ones all went to earlier leaders may be in no pair, so lack items.
            lone = materialise(open_.select("key").distinct().join(items.select("key"), "key", "left_anti"), "lone")
            if lone.limit(1).count():
                items = items.unionByName(shingle_sets(lone, nodes, docs))
            whole = open_.join(labelled(nodes.select("key", "s0", "s1", "size")), "key")
            # Sets that are too much for a task meet in pairs of blocks.
            weight = whole.groupBy(*BUCKET).agg(F.sum(F.col("size").cast("long") * 8).alias("w")).where(F.col("w") > block_bytes)
            weight = materialise(weight, "heavy")
            if weight.limit(1).count():
                heavy = blocks(whole.withColumn("old", F.col("salt")).drop("salt").join(weight.select("level", "trie", "prefix", F.col("salt").alias("old")), ["level", "trie", "prefix", "old"], "left_semi"), ["level", "trie", "prefix", "old"], weight.withColumnRenamed("salt", "old"), block_bytes)
                heavy = heavy.withColumn("salt", F.xxhash64("old", "salt")).drop("old")
                whole = whole.join(weight, BUCKET, "left_anti").unionByName(heavy)
            labels = components(edges.union(materialise(compact(bucket_links(whole.join(items, "key"), cuts), docs), "links")))
    return prints, labels


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, class_id (smallest doc_id of the
    class), class_size, kept (one row of each class: that with class_id, and of several such
    rows that whose text has the smallest md5, one row where that repeats).

    Null texts count as empty; texts without words form one class. A null doc_id is passed
    over for class_id, which is null only if the class has no other. Other columns are
    ignored; an empty table gives an empty result."""
    return _named(*links(docs)).drop("tie")


def _named(prints: DataFrame, labels: DataFrame) -> DataFrame:
    named = prints.select("row", "doc_id", "tie", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("row", "doc_id", "tie", F.coalesce("label", "key").alias("label"))
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row"))
    # Written, so that the join with them is one that adaptive execution splits where a class is hot.
    classes = materialise(named.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), head.alias("head")), "classes")
    return named.join(classes, "label").select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"), "tie")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that which ``near_groups`` keeps. Rows are named by doc_id
    and text, so of several texts under one id only those kept stay; of rows equal in both,
    one stays."""
    name, digest, tie = free_name(docs, "kept__"), free_name(docs, "digest__"), free_name(docs, "tie__")
    prints, labels = links(docs)
    kept = _named(prints, labels).where("kept").select(F.col("doc_id").alias(name), F.col("tie").alias(tie))
    own = docs.withColumn(digest, F.md5(whole_text())).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(tie)), "left_semi")
    if prints.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["doc_id", digest])
    return own.select(*docs.columns)
