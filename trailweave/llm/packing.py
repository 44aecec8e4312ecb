"""Hierarchical packing into several context sizes.

Each task tokenises its documents and packs a window of them at a time, so nothing is
shuffled. Whole windows of the longest context are cut off a document; what is left goes to
the tier of the smallest context that holds it. Each tier is packed best fit first; gaps of
long windows are filled from shorter tiers, cutting a piece where none fits. An unfilled
window waits for the next documents; a task's very last one is cut at powers of two.
Sequences are dealt to step groups so that attention cost is even.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import common
from trailweave.llm.common import columns, partition_id, whole_text
from trailweave.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
Piece = tuple[int, int, int]  # length, document, start


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest context that holds it."""
    return next(t for t in tiers if length <= t)


def fill(room: int, pools: dict[int, list[Piece]], order: list[int]) -> list[Piece]:
    """Pieces for exactly ``room`` tokens, or all there are: the largest that fits, from the
    longest tier down; where none fits, the head of the smallest left is cut."""
    got = []
    while room:
        for tier in order:
            at = bisect_right(pools[tier], (room, 1 << 62, 0)) - 1
            if at >= 0:
                got.append(pools[tier].pop(at))
                room -= got[-1][0]
                break
        else:
            tier = next((t for t in reversed(order) if pools[t]), None)
            if tier is None:
                break
            length, doc, start = pools[tier].pop(0)
            got.append((room, doc, start))
            insort(pools[tier_of(length - room)], (length - room, doc, start + room))
            room = 0
    return got


def pack(lengths: list[tuple[int, int]], last: bool, tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces from (document, length), and the pieces left over if not last."""
    top = tiers[-1]
    pools: dict[int, list[Piece]] = {t: [] for t in tiers}
    done: list[list[Piece]] = []
    for doc, start, length in lengths:
        while length >= top:
            done.append([(top, doc, start)])
            start, length = start + top, length - top
        if length:
            pools[tier_of(length, tiers)].append((length, doc, start))
    for pool in pools.values():
        pool.sort()
    left: list[Piece] = []
    for tier in reversed(tiers):
        shorter = [t for t in reversed(tiers) if t <= tier]
        while pools[tier]:
            piece = pools[tier].pop()
            window = [piece, *fill(tier - piece[0], pools, shorter)]
            if sum(p[0] for p in window) == tier:
                done.append(window)
            else:
                left += window
    if last and left:
        # As powers of two, which need no padding.
        total, at = sum(p[0] for p in left), 0
        for power in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            if not total & power:
                continue
            window, room = [], power
            while room:
                length, doc, start = left[at]
                cut = min(length, room)
                window.append((cut, doc, start))
                room -= cut
                if cut == length:
                    at += 1
                else:
                    left[at] = (length - cut, doc, start + cut)
            done.append(window)
        left = []
    return done, left


def step_groups(sequences: list[list[Piece]], group_tokens: int) -> list[int]:
    """A step group for each sequence: costliest first, to the group with the least cost."""
    groups = max(1, round(sum(p[0] for s in sequences for p in s) / group_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sequences)
    costs = [(sum(p[0] * p[0] for p in s), i) for i, s in enumerate(sequences)]
    for cost, i in sorted(costs, reverse=True):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + cost, g))
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("step_group", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str = "byte", end_id: int = END_ID, window_tokens: int = 1 << 20, group_tokens: int = 1 << 17, with_ids: bool = False, table: int = 700_000) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, sequence_length, step_group (and the ids, as bytes of
    little-endian 32-bit integers, with ``with_ids``).

    Null and empty texts are the end id alone; null and repeated doc_ids are packed row by
    row. Other columns are ignored; an empty table gives an empty result. Sequence and group
    numbers hold the task's number in their high bits, so they are unique and a repeated
    task gives the same. A task holds ``window_tokens`` ids and one document's at most, and a
    worker the ids of ``table`` known chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer_path, kind, table), partition_id() << 40
        held: dict[int, tuple[int | None, memoryview]] = {}
        waiting: list[tuple[int, int, int]] = []
        count = tokens = sequence = group = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal waiting, tokens, sequence, group, held
            done, left = pack(waiting, last)
            groups = step_groups(done, group_tokens)
            rows: list[list] = [[] for _ in RESULT]
            ids = []
            for window, own in zip(done, groups):
                offset, size = 0, sum(p[0] for p in window)
                for length, doc, start in window:
                    name, code = held[doc]
                    view = code[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (name, start, length, zlib.crc32(view), len(code) // 4, base + sequence, offset, size, base + group + own)):
                        column.append(value)
                    if with_ids:
                        ids.append(bytes(view))
                    offset += length
                sequence += 1
            group += max(groups, default=-1) + 1
            waiting = [(doc, start, length) for length, doc, start in left]
            held = {doc: held[doc] for doc, _, _ in waiting}
            tokens = sum(x[2] for x in waiting)
            if not rows[0]:
                return None
            arrays = [pa.array(c, pa.int64()) for c in rows]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], schema=RESULT.append(pa.field("ids", pa.binary()))) if with_ids else pa.RecordBatch.from_arrays(arrays, schema=RESULT)

        for batch in batches:
            own = columns(batch, "doc_id")[0]
            for at, ids, bounds in encode.documents(batch.column(1), end_id):
                whole, edges = memoryview(ids).cast("B"), bounds.tolist()
                for k in range(len(edges) - 1):
                    held[count] = (own[at + k], whole[4 * edges[k] : 4 * edges[k + 1]])
                    waiting.append((count, 0, edges[k + 1] - edges[k]))
                    tokens += edges[k + 1] - edges[k]
                    count += 1
                    if tokens >= window_tokens and (out := flush(False)) is not None:
                        yield out
        if (out := flush(True)) is not None:
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document of the stage before. The workers' table of known chunks is
    smaller than in ``op10``, as they have run the other stages too; results don't change."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), table=250_000)
