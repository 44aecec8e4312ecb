"""Media columns stored as content-defined chunks.

A payload becomes an 8-bit sound file. A rolling gear hash cuts it where its content says
so, and each chunk goes once into a pack file of the task, compressed. Digests meet in a
Spark join that names one stored copy for each; a row of the recipe lists its chunks in
order. Reading joins nothing but the recipe: bytes are fetched from the packs by range and
verified against the digest of the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import attempt_name, chunked, columns, filesystem, materialise, partition_id, shared_dir, table, whole_text

FRAME = 576
RATE = 8000
LEAST, MASK_BITS, MOST = 1024, 12, 16384
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with 255 to a positive multiple of the frame; and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono sound; a sample is a byte of the payload."""
    pad = len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a sound file of this kind")
    (n,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + n]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash of the last 32 bytes, for all places at once, by
    doubling; a chunk ends where its low bits are zero, after LEAST bytes, or after MOST."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ends, at = [], 0
    # The high bits have seen the whole window of 32 bytes.
    for place in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST:
            at = place
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def feature_of(samples: bytes) -> str:
    """Mean, deviation, zero crossings and entropy of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(x))
    deviation = float(np.sqrt(max(0.0, (counts * level * level).sum() / len(x) - mean * mean)))
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    p = counts[counts > 0] / len(x)
    return f"mean={mean:.4f};deviation={deviation:.4f};crossings={crossings};entropy={float(-(p * np.log2(p)).sum()):.4f}"


RECIPE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("pos", pa.int32()), ("digest", pa.binary()), ("length", pa.int32()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())])
RECIPE_DDL = "row long, doc_id long, n_bytes long, media_sha256 string, pos int, digest binary, length int, pack string, at long, size int"


def store_media(docs: DataFrame, pack_bytes: int = 16 << 20) -> DataFrame:
    """Store each whole text of ``docs(doc_id, text)`` (null: empty) as media in chunks.

    Returns the recipe, one row per chunk of a row: row (a number of its own for every input
    row, so null and repeated doc_ids do no harm), doc_id, n_bytes, media_sha256, pos,
    digest, length, and where the chunk lies: pack, at, size. Other columns are ignored.
    """
    folder = shared_dir(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, squeeze = partition_id(), attempt_name(), zstandard.ZstdCompressor(level=3)
        seen: dict[bytes, tuple[str, int, int]] = {}
        number, row, blobs, size = 0, part << 40, [], 0
        system, path = filesystem(folder)

        def close() -> None:
            nonlocal number, blobs, size
            if not blobs:
                return
            system.create_dir(path, recursive=True)
            temporary = f"{path}/.{part:06d}-{number:05d}.{attempt}.tmp"
            with system.open_output_stream(temporary, compression=None) as out:
                for blob in blobs:
                    out.write(blob)
            system.move(temporary, f"{path}/{part:06d}-{number:05d}.pack")
            number, blobs, size = number + 1, [], 0

        for batch in chunked(batches, 1000):
            rows = []
            for doc, text in zip(*columns(batch, "doc_id", "text")):
                payload, n = payload_of(text)
                media = to_wav(payload)
                whole, at = hashlib.sha256(media).hexdigest(), 0
                for pos, end in enumerate(cuts(media)):
                    chunk = media[at:end]
                    name = hashlib.sha256(chunk).digest()
                    place = seen.get(name)
                    if place is None:
                        blob = squeeze.compress(chunk)
                        if size and size + len(blob) > pack_bytes:
                            close()
                        place = (f"{folder}/{part:06d}-{number:05d}.pack", size, len(blob))
                        blobs.append(blob)
                        size += len(blob)
                        if len(seen) >= 200_000:  # a bound on memory; the join below finds what repeats beyond it
                            seen.clear()
                        seen[name] = place
                    rows.append((row, doc, n, whole, pos, name, end - at, *place))
                    at = end
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECIPE)], schema=RECIPE)
        close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(write, RECIPE_DDL)
    own = materialise(own, "media-recipe")
    # Only digests that lie in more than one place need another copy named: small beside the rest.
    place = F.struct("pack", "at", "size")
    chosen = own.groupBy("digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("digest", "low")
    joined = own.join(chosen, "digest", "left")
    return joined.select("row", "doc_id", "n_bytes", "media_sha256", "pos", "digest", "length", *(F.coalesce(F.col(f"low.{c}"), F.col(c)).alias(c) for c in ("pack", "at", "size")))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


class Packs:
    """Chunks by place. The last few packs read stay in memory, so rows that follow their
    order in the packs read each once; the number of open packs is bounded."""

    def __init__(self, keep: int = 6):
        self.keep, self.blobs, self.expand = keep, OrderedDict(), zstandard.ZstdDecompressor()

    def chunk(self, pack: str, at: int, size: int, length: int, home: bool) -> bytes:
        blob = self.blobs.get(pack)
        if blob is None and home:
            system, path = filesystem(pack)
            with system.open_input_stream(path, compression=None) as source:
                blob = self.blobs[pack] = source.read()
            if len(self.blobs) > self.keep:
                self.blobs.popitem(last=False)
        if blob is not None:
            raw = blob[at : at + size]
        else:
            system, path = filesystem(pack)
            with system.open_input_file(path) as source:
                raw = source.read_at(size, at)
        return self.expand.decompress(raw, max_output_size=length)


def read_media(recipe: DataFrame) -> DataFrame:
    """Rebuild every row's media from its ordered chunk list, verify it against the digest of
    the whole, and compute features of the samples. One row per stored row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs()
        for batch in chunked(batches, 500):
            rows = []
            for doc, n, whole, parts in zip(*columns(batch, "doc_id", "n_bytes", "media_sha256", "parts")):
                parts.sort(key=lambda p: p["pos"])
                home = parts[0]["pack"]
                media = b"".join(packs.chunk(p["pack"], p["at"], p["size"], p["length"], p["pack"] == home) for p in parts)
                found = hashlib.sha256(media).hexdigest()
                if found != whole:
                    raise ValueError("the chunks of a row don't give its media")
                payload = from_wav(media)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), found, feature_of(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)

    lists = recipe.groupBy("row", "doc_id", "n_bytes", "media_sha256").agg(F.collect_list(F.struct("pos", "pack", "at", "size", "length")).alias("parts"))
    lists = lists.sortWithinPartitions(F.col("parts")[0]["pack"], F.col("parts")[0]["at"])
    return lists.select("doc_id", "n_bytes", "media_sha256", "parts").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents")))
