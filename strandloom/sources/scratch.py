"""Tables in the folder that driver and executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may go without: one process then reads and writes."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; the master is {master}")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is written there goes when the process ends, or when it is discarded."""
    path = f"{shared_dir(spark)}/strandloom-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_remove_left, spark)
    _left.append(path)
    return path


# Parquet writer options by which a row group ends after any row, at 8 MB, instead of after a hundred rows at least.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}


def stored(spark: SparkSession, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again. wide is for rows of megabytes: what a task holds to write or read them is then a row group of 8 MB or one longer row."""
    path = new_path(spark, name)
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a stored table that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete(spark, path)
        with contextlib.suppress(ValueError):
            _left.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def can_write(spark: SparkSession, path: str) -> bool:
    """Whether a file can be made under path: a probe before a long run; the probe is removed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/.probe-{uuid.uuid4().hex}")
    try:
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.create(at, False).close()
        return bool(files.delete(at, False))
    except Exception:  # noqa: BLE001 - any failure is the answer
        return False


def _remove_left(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        for path in _left:
            delete(spark, path)
