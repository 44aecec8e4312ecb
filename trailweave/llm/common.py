"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that don't find it on their path."""
    package = Path(__file__).resolve().parents[1]
    paths = (spark._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep)
    context = spark.sparkContext
    if str(package.parent) in paths or getattr(context, "_trailweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="trailweave-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._trailweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on a local
    master (tests on one machine) a temporary folder is made and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_base(spark)}/trailweave/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends there, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(manifest: DataFrame) -> DataFrame:
    """A manifest in as many partitions as there are cores. It has a row or so a task, which
    else becomes a Parquet file a task; for each, Hadoop starts processes to set modes."""
    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism)


FILE_BYTES = 128 << 20  # of documents to a file of their small rows


def compact(small: DataFrame, docs: DataFrame) -> DataFrame:
    """Small rows made from ``docs`` in as many partitions as the estimated bytes of docs ask
    for, all cores at least, and no more than a shuffle has. Else each reading task writes a
    file, and for each file Hadoop starts processes, as in ``few_files``."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return small.repartition(min(most, max(cores, -(-size // FILE_BYTES))))


def tasks_for(spark: SparkSession, files: int, size: int, each: int) -> int:
    """Tasks to read ``files`` of ``size`` together: some ``each`` a task, all cores at least,
    but no task without a file beyond those."""
    return max(spark.sparkContext.defaultParallelism, min(files, -(-size // each)))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes, attempt: str) -> None:
    """Write under a temporary name, then rename: readers never see half a file, and a
    repeated task replaces the file by an equal one."""
    system, path = filesystem(uri)
    folder = path.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{path.rpartition('/')[2]}.{attempt}.tmp"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, path)


def read_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def attempt_name() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return str(context.taskAttemptId()) if context else uuid.uuid4().hex


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each starts, with the end of the
    last. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def chunked(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that a batch of long texts doesn't multiply in memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def free_name(df: DataFrame, hint: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while hint.lower() in taken:
        hint += "_"
    return hint
