"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by range of page_id in one shuffle, files roll at a compressed size,
headers and digests are made anew, and a file gets its name only when it is whole. The
manifest lists the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import attempt_name, chunked, columns, few_files, filesystem, materialise, partition_id, read_file, shared_dir, table, tasks_for, whole_text

SPACE = uuid.UUID("6f0c1d5e-2b7a-5c58-9d3b-0a4e8f7c1b22")
DATE = "2000-01-01T00:00:00Z"
READ_TOGETHER = 8 << 20  # compressed bytes to a reading task


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit has the HTTP head without the payload."""
    name = "" if page_id is None else str(page_id)
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c for c in (url or "") if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'{name} {digest}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE, f'{refers_to} {digest}')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page-ID: {name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file in which every record is one gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("a file that ends within a record")
            piece = view[at : at + (1 << 14)]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, least_bytes: int = 0, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns the manifest (file, records, bytes).

    Null html is the empty payload, null url an empty one. Of equal payloads of at least
    ``least_bytes`` bytes, records with the smallest page_id are responses (all of them where
    that id repeats) and the others revisit it; shorter ones are all responses. Null ids are
    written but referred to by none. Other columns are ignored. Payloads are compared by
    SHA-256 and length in a table of ids only; the pages themselves are shuffled once.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    html = whole_text("html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat_ws(":", F.sha2(html, 256), F.octet_length(html)).alias("key"), F.octet_length(html).alias("size"))
    groups = own.where(F.col("size") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("key", "first")
    revisits = own.join(groups, "key").where("page_id IS NULL OR page_id <> first").select("page_id", "key", "first").distinct()
    marks = materialise(revisits, "warc-revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, pending, number = partition_id(), attempt_name(), None, 0
        out = system = None
        name = temporary = ""
        count = size = 0

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.close()
            system.move(temporary, name)
            out, number = None, number + 1
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}"], "records": [count], "bytes": [size]}, schema=MANIFEST)

        for batch in chunked(batches, 500):
            for page, key, tag, first, url, html_ in zip(*columns(batch, "page_id", "key", "tag", "first", "url", "html")):
                if tag == 0:
                    pending = (page, key, first)
                    continue
                revisit = pending is not None and pending[:2] == (page, key)
                raw = record_bytes(page, url, html_.encode("utf-8", "surrogatepass"), pending[2] if revisit else None, revisit)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(raw) + squeeze.flush()
                if out is None:
                    system, path = filesystem(folder)
                    system.create_dir(path, recursive=True)
                    name = f"{path}/part-{part:06d}-{number:05d}.warc.gz"
                    temporary = f"{path}/.part-{part:06d}-{number:05d}.{attempt}.tmp"
                    out, count, size = system.open_output_stream(temporary, compression=None), 0, 0
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    yield close()
        if out is not None:
            yield close()

    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat_ws(":", F.sha2(html, 256), F.octet_length(html)).alias("key"), F.lit(1).alias("tag"), F.lit(None).cast("long").alias("first"), F.col("url").cast("string").alias("url"), html.alias("html"))
    notes = marks.select("page_id", "key", F.lit(0).alias("tag"), "first", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"))
    rows = body.unionByName(notes).repartitionByRange("page_id", "key").sortWithinPartitions("page_id", "key", "tag", "url")
    return materialise(few_files(rows.mapInArrow(write, "file string, records long, bytes long")), "warc-manifest")


RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, file. Every block's digest is checked, and the payload digest of each response."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in columns(batch, "file")[0]:
                rows = []
                for fields, block in records(read_file(uri)):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if f"sha1:{payload_digest(block)}" != fields["WARC-Block-Digest"] or kind == "response" and (payload_digest(payload) != digest or length != len(payload)):
                        raise ValueError(f"damaged record in {uri}")
                    page, other = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, length, digest, kind, int(other) if other else None, fields["WARC-Target-URI"], uri))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), RESULT)], schema=RESULT)

    spark = manifest.sparkSession
    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    spread = manifest.select("file").repartition(tasks_for(spark, files, size, READ_TOGETHER))
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url", "file")
