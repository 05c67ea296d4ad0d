"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd factors that rolling hashes multiply the places of a window with.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a
    folder made once; any other raises, as its executors wouldn't see one another's files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.shared.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.shared.dir", path)
    return path


def table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what table() wrote for df, when no later plan reads it."""
    path = getattr(df, "_quarry_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_or_plain(df: DataFrame, n_rows: int, limit: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else df for a shuffled join."""
    return F.broadcast(df) if n_rows <= limit else df


def small_by_bytes(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """df marked for broadcast if the sizes of its rows, which `size` tells, add up to no more than the limit, else df for a
    shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df


def trim() -> None:
    """Gives memory that is free in this process back to the system; without it, a worker keeps the most it ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that trims its worker when it is done."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return inner


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 3_000) -> Iterator[None]:
    """What runs meanwhile hands texts to Python in batches of so many rows: a batch of the default size takes tens of
    megabytes in the JVM and some times that in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def nullable(df: DataFrame, name: str) -> Column:
    """A column whose nested fields may be null, as Python workers return them."""
    return F.col(name).cast(df.schema[name].dataType.simpleString()).alias(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may start elsewhere; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    to = Path(tempfile.mkdtemp(prefix="quarry-code-")) / "quarry_code.zip"
    with zipfile.ZipFile(to, "w") as out:
        for p in sorted((root / "quarry").rglob("*.py")):
            out.write(p, p.relative_to(root))
    sc.addPyFile(str(to))
    sc._quarry_shipped = True
