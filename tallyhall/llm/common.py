"""What the training-data operators share: tables, scratch tables and remote files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyhall.plans.registry import spread

#: Arrow batches handed to Python hold at most so many rows and bytes, so that
#: a run of very long texts cannot outgrow a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="tallyhall-ship-")) / "tallyhall.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))


def tuned(spark: SparkSession) -> SparkSession:
    """Ship the package; bound Arrow batches; drop shuffle files as soon as the job that made them ends.

    The three settings stay set: results are lazy, and the caller's action needs them.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset and everything runs in one process, as in tests, a
    temporary folder becomes the session's checkpoint folder; on a cluster it
    must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyhall-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/tallyhall/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads; any other table is left alone."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_stash_path", None)
    if path is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(url: str):
    """(file system, path) of a URL, for code on executors: file, hdfs, s3 or gs."""
    from pyarrow import fs

    if "://" not in url:
        url = "file://" + url.removeprefix("file:") if url.startswith("file:") else "file://" + os.path.abspath(url)
    return fs.FileSystem.from_uri(url)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A text column as str, null as empty."""
    return [x or "" for x in column.to_pylist()]
