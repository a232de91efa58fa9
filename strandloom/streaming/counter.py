"""Token counts that follow a growing folder of text files, in a table that outlives the query.

Every micro-batch writes its own counts, partly summed, under its number: written again, they replace themselves, so a batch that
is repeated after a failure counts once. The counts are the sum of a base and of the batches after it. Now and then all batches so far are merged into a new
base, which a manifest, written last, puts in force.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions.tokens import words
from strandloom.operators.vocab import merge
from strandloom.sources import checkpoints, scratch

SCHEMA = "token string, count long"
#: Batches after which they are merged into the base.
MERGE_AFTER = 20


class CountStore:
    def __init__(self, spark: SparkSession, root: str, merge_after: int = MERGE_AFTER):
        self.spark, self.root, self.merge_after = spark, root.rstrip("/"), merge_after

    def merged_to(self) -> int:
        """The last batch that the base holds; -1 for no base."""
        said = checkpoints.read_text(self.spark, f"{self.root}/manifest.json")
        return json.loads(said)["merged_to"] if said else -1

    def batches(self) -> list[int]:
        """Numbers of the batches after the base that were written whole."""
        files, at = checkpoints._files(self.spark, f"{self.root}/batches")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        numbers = sorted(int(n[6:]) for n in names if n.startswith("batch="))
        base = self.merged_to()
        return [n for n in numbers if n > base and files.exists(checkpoints._files(self.spark, f"{self.root}/batches/batch={n}/_SUCCESS")[1])]

    def add(self, tokens: DataFrame, batch: int) -> None:
        """Counts a micro-batch of tokens."""
        if batch <= self.merged_to():
            return  # it was counted before the query failed
        counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
        counts.write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")
        if len(self.batches()) >= self.merge_after:
            self.merge_batches()

    def counts(self) -> DataFrame:
        """(token, count) of all batches."""
        base, parts = self.merged_to(), [f"{self.root}/batches/batch={n}" for n in self.batches()]
        tables = [self.spark.read.schema(SCHEMA).parquet(f"{self.root}/base={base}")] if base >= 0 else []
        tables += [self.spark.read.schema(SCHEMA).parquet(*parts)] if parts else []
        return merge(*tables) if tables else self.spark.createDataFrame([], SCHEMA)

    def merge_batches(self) -> None:
        numbers, old = self.batches(), self.merged_to()
        if not numbers:
            return
        self.counts().write.mode("overwrite").parquet(f"{self.root}/base={numbers[-1]}")
        checkpoints.write_text(self.spark, f"{self.root}/manifest.json", json.dumps({"merged_to": numbers[-1]}))
        for n in numbers:
            scratch.delete(self.spark, f"{self.root}/batches/batch={n}")
        if old >= 0:
            scratch.delete(self.spark, f"{self.root}/base={old}")


def tokens_of(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming (token): a row for each occurrence in the lines of new files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.explode(words(F.col("value"))).alias("token"))


def token_counts(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming (token, count); write it in complete or update mode."""
    return tokens_of(spark, path, files_per_trigger).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def start_counter(spark: SparkSession, path: str, store: CountStore, checkpoint: str, files_per_trigger: int = 100):
    """A query that adds what is there now, and wasn't there before, to the store."""
    writer = tokens_of(spark, path, files_per_trigger).writeStream.foreachBatch(store.add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
