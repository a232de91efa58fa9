"""Epoch checkpoints: tables of an epoch, committed by a manifest that is written last.

``root/epoch=N/<table>`` holds Parquet; ``root/epoch=N/manifest.json`` names the tables with their row counts and holds plain values. An epoch
without a manifest is one that was interrupted: nothing reads it, and it is written over. All paths go through Spark's file systems, so a checkpoint lies
wherever the cluster can write.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from . import scratch

MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole or not at all: it is written beside its place and moved there."""
    files, at = _files(spark, path)
    _, beside = _files(spark, f"{path}.part")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"can't move {beside} to {at}")


def read_text(spark: SparkSession, path: str) -> str | None:
    files, at = _files(spark, path)
    if not files.exists(at):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file


@dataclass
class Saved:
    spark: SparkSession
    root: str
    epoch: int
    tables: dict
    values: dict

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/epoch={self.epoch}/{name}")


def plain(settings, *without: str) -> dict:
    return {k: v for k, v in asdict(settings).items() if k not in without}


def save_epoch(spark: SparkSession, root: str, epoch: int, tables: dict[str, DataFrame], values: dict, keep: int = 2) -> None:
    """Writes the tables, then the manifest; only the last keep committed epochs stay."""
    here, counts = f"{root}/epoch={epoch}", {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{here}/{name}")
        counts[name] = spark.read.parquet(f"{here}/{name}").count()
    write_text(spark, f"{here}/{MANIFEST}", json.dumps({"epoch": epoch, "tables": counts, "values": values}, indent=1))
    for old in sorted(_committed(spark, root))[:-keep]:
        scratch.delete(spark, f"{root}/epoch={old}/{MANIFEST}")  # no longer committed, whatever of the rest is gone
        scratch.delete(spark, f"{root}/epoch={old}")


def _committed(spark: SparkSession, root: str) -> list[int]:
    files, at = _files(spark, root)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    epochs = [int(n[6:]) for n in names if n.startswith("epoch=") and n[6:].isdigit()]
    return [e for e in epochs if files.exists(_files(spark, f"{root}/epoch={e}/{MANIFEST}")[1])]


def last_epoch(spark: SparkSession, root: str) -> Saved | None:
    """The last committed epoch, or None."""
    epochs = _committed(spark, root)
    if not epochs:
        return None
    said = json.loads(read_text(spark, f"{root}/epoch={max(epochs)}/{MANIFEST}"))
    return Saved(spark, root, max(epochs), said["tables"], said["values"])
