"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where the setting is missing."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="scholarium-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of BATCH_BYTES, where the session still has Spark's default of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "1b").lower() in ("67108864b", "64mb", "64m"):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trim() -> None:
    """Give freed memory back to the system.  Arrow's pool keeps its own, whatever malloc gives back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def task(run):
    """``run`` over a task's batches; a worker that Spark uses again keeps none of the task's freed buffers."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files outlive any executor, so a lost executor never recomputes what
    stands before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scholarium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def row_key(*cols: str) -> Column:
    """Key of a row by content: rows that agree in ``cols`` share it (and so their results)."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])
