"""Token ids in directly addressable codes.

A file holds the ids of many documents. Ids are split into 8-bit chunks by level: level 0
has the low chunk of every id, level k the k-th chunk of those ids that need it. Each level
but the last has a continuation bitmap and a rank directory (ones before every 512th bit),
so that the ids of any range are read with one rank for each level: bytes before the range
are neither read nor decoded.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import attempt_name, columns, few_files, filesystem, materialise, partition_id, shared_dir, table, tasks_for, whole_text, write_file
from trailweave.llm.tokens import encoder

MAGIC = b"TWDAC001"
RANK_BITS = 512
END_ID = 1
READ_TOGETHER = 1 << 24  # ids to a reading task


def encode_codes(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The bytes of a file. starts: of each document, and the end of the last."""
    levels, parts, rest = [], [], ids.astype(np.uint32)
    while True:
        low, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        last = not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b""
        if not last:
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64)
            ranks = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u8").tobytes()
        levels.append({"n": len(low), "bits": len(bits), "ranks": len(ranks)})
        parts += [low.tobytes(), bits, ranks]
        if last:
            break
        rest = rest[more] >> 8
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": levels}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, names.tobytes(), known.tobytes(), starts.astype("<i8").tobytes(), *parts])


class Codes:
    """A file of codes, read by range: opening it reads the documents' names and starts alone."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token code file")
        (size,) = struct.unpack("<I", self._read(8, 4))
        head, at = json.loads(self._read(12, size)), 12 + size
        self.n, docs = head["tokens"], head["docs"]
        names, known = np.frombuffer(self._read(at, 8 * docs), "<i8"), self._read(at + 8 * docs, docs)
        self.doc_ids = [int(n) if k else None for n, k in zip(names, known)]
        at += 9 * docs
        self.starts = np.frombuffer(self._read(at, 8 * docs + 8), "<i8")
        at += 8 * docs + 8
        self.levels = []
        for x in head["levels"]:
            self.levels.append((at, at + x["n"], at + x["n"] + x["bits"], x["bits"] > 0))
            at += x["n"] + x["bits"] + x["ranks"]

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        return int(self.ids(place, place + 1)[0])

    def ids(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from ``start`` to before ``stop``: their low chunks, and by one rank a level
        the range of the next level that holds the rest. Nothing before the range is decoded."""
        low, bits, ranks, more = self.levels[level]
        out = np.frombuffer(self._read(low + start, stop - start), np.uint8).astype("<u4")
        if not more or not len(out):
            return out
        block = start // RANK_BITS
        first = block * RANK_BITS // 8
        flags = np.unpackbits(np.frombuffer(self._read(bits + first, (stop + 7) // 8 - first), np.uint8), bitorder="little")[: stop - block * RANK_BITS].view(bool)
        before, own = flags[: start - block * RANK_BITS], flags[start - block * RANK_BITS :]
        count = int(own.sum())
        if count:
            (rank,) = struct.unpack("<Q", self._read(ranks + 8 * block, 8))
            rank += int(before.sum())
            out[own] |= self.ids(rank, rank + count, level + 1) << 8
        return out

    def documents(self, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the document and its ids, in ranges of some ``most`` ids; a longer document
        comes in several parts."""
        doc, docs = 0, len(self.doc_ids)
        while doc < docs:
            last = max(doc + 1, int(np.searchsorted(self.starts, self.starts[doc] + most, "right")) - 1)
            start, stop = int(self.starts[doc]), int(self.starts[last])
            for at in range(start, stop, most) if last == doc + 1 else ():
                yield doc, self.ids(at, min(stop, at + most))
            if last > doc + 1:
                ids, edges = self.ids(start, stop), (self.starts[doc : last + 1] - start).tolist()
                for k in range(last - doc):
                    yield doc + k, ids[edges[k] : edges[k + 1]]
            doc = last


def write_token_files(docs: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = END_ID, tokens_per_file: int = 1 << 22) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into code files in ascending order of doc_id.

    Null texts count as empty; each document ends with ``end_id``. Null ids come first; rows
    with equal ids lie in an order given by a hash of their texts. Other columns are
    ignored. Returns the manifest: file, part, number, tokens before it in its part,
    n_tokens, n_docs. A task holds one file's ids at most, plus one document's.
    """
    folder = shared_dir(docs.sparkSession, "token-codes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, attempt = encoder(tokenizer_path, kind), partition_id(), attempt_name()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        starts: list[np.ndarray] = []
        number = before = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held, names, starts, total
            uri = f"{folder}/part-{part:06d}-{number:05d}.dac"
            write_file(uri, encode_codes(np.concatenate(held), names, np.concatenate((*starts, [total]))), attempt)
            row = {"file": [uri], "part": [part], "number": [number], "before": [before], "n_tokens": [total], "n_docs": [len(names)]}
            number, before, held, names, starts, total = number + 1, before + total, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST)

        for batch in batches:
            own = columns(batch, "doc_id")[0]
            for at, ids, bounds in encode.documents(batch.column(1), end_id):
                doc, docs = 0, len(bounds) - 1
                while doc < docs:
                    last = min(docs, max(doc + 1, int(np.searchsorted(bounds, bounds[doc] + tokens_per_file - total))))
                    held.append(ids[bounds[doc] : bounds[last]])
                    names += own[at + doc : at + last]
                    starts.append(bounds[doc:last] - bounds[doc] + total)
                    total += int(bounds[last] - bounds[doc])
                    doc = last
                    if total >= tokens_per_file:
                        yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    written = ordered.mapInArrow(write, "file string, part long, number long, before long, n_tokens long, n_docs long")
    return materialise(few_files(written), "token-manifest")


MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, file.

    Only the counts of tokens and files of each partition of the writer come to the driver:
    two numbers a task, however large the input.
    """
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"], r["files"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("files")).collect())
    offsets, run = [], 0
    for part, n, _ in totals:
        offsets.append((part, run))
        run += n
    starts = spark.createDataFrame(offsets, "part long, part_start long")
    placed = manifest.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*columns(batch, "file", "start")):
                system, path = filesystem(uri)
                with system.open_input_file(path) as file:
                    codes = Codes(file)
                    crc = np.zeros(len(codes.doc_ids), np.int64)
                    for doc, ids in codes.documents():
                        crc[doc] = zlib.crc32(ids.data, int(crc[doc]))
                edges = codes.starts
                yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids, pa.int64()), pa.array(edges[:-1] + start), pa.array(np.diff(edges)), pa.array(crc), pa.array([uri] * len(crc), pa.string())], schema=RESULT)

    spread = placed.select("file", "start").repartition(tasks_for(spark, sum(t[2] for t in totals), run, READ_TOGETHER))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))).select("doc_id", "start", "n_tokens", "ids_crc32")
