"""Saved dictionaries, embeddings, batches and results: Parquet, and text for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocabulary")


def prepare(tokens: DataFrame, path: str, min_frequency: int = 0, reverse_complement: bool = False) -> DataFrame:
    """Counts the tokens, saves the counts unpruned under path, and gives the pruned vocabulary with UNK."""
    from strandloom.operators import vocab

    vocab.count_tokens(tokens).write.mode("overwrite").parquet(f"{path}/counts")
    return load_prepared(tokens.sparkSession, path, min_frequency, reverse_complement)


def load_prepared(spark: SparkSession, path: str, min_frequency: int = 0, reverse_complement: bool = False) -> DataFrame:
    """The vocabulary from counts that prepare has saved, pruned anew; UNK's count is what pruning gave it."""
    from strandloom.operators import vocab

    pruned = vocab.prune(spark.read.parquet(f"{path}/counts"), min_frequency)
    rest = pruned.where(F.col("token") == vocab.UNK).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return vocab.with_unk(vocab.build(pruned, reverse_complement=reverse_complement), rest)


def require_prepared(vocab: DataFrame | None) -> DataFrame:
    """The vocabulary, or an error: nothing is generated before counts are made or loaded."""
    if vocab is None:
        raise RuntimeError("prepare or load a vocabulary first")
    return vocab


def export_text(vocab: DataFrame, path: str) -> None:
    """``token id`` lines under token-map, ``token count`` lines under counter-sampler, gzip; files in order of id."""
    for name, value in (("token-map", "id"), ("counter-sampler", "count")):
        lines = vocab.orderBy("id", "token").select(F.concat_ws(" ", "token", F.col(value).cast("string")).alias("value"))
        lines.write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}")


def import_text(spark: SparkSession, path: str) -> DataFrame:
    """(token, id, count) from what export_text wrote."""

    def read(name: str, value: str, kind: str) -> DataFrame:
        return spark.read.text(f"{path}/{name}").select(F.regexp_replace("value", " [^ ]*$", "").alias("token"), F.substring_index("value", " ", -1).cast(kind).alias(value))

    counts = read("counter-sampler", "count", "long")
    return read("token-map", "id", "int").join(counts, "token", "left").select("token", "id", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of one small file that is read whole: the line's number is the id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("id", "value"))


def export_token_lines(vocab: DataFrame, path: str) -> None:
    """A plain list, the line's number being the id: one file."""
    vocab.orderBy("id", "token").select(F.col("token").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a plain list."""
    return _numbered_lines(spark, path).select(F.col("value").alias("token"), "id")


def export_dense(counts: DataFrame, path: str) -> None:
    """Counts of the ids from 0, one a line, in one file."""
    counts.orderBy("id").select(F.col("count").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_dense(spark: SparkSession, path: str) -> DataFrame:
    """(id, count) from what export_dense wrote."""
    return _numbered_lines(spark, path).select(F.col("id").cast("long").alias("id"), F.col("value").cast("long").alias("count"))


def save_embeddings(model: DataFrame, path: str, epoch: int | None = None) -> None:
    model.write.mode("overwrite").parquet(f"{path}/embeddings" + ("" if epoch is None else f"/epoch={epoch}"))


def load_embeddings(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/embeddings" + ("" if epoch is None else f"/epoch={epoch}"))


def save_macrobatches(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").partitionBy("macrobatch_id").parquet(path)


def load_macrobatch(spark: SparkSession, path: str, macrobatch: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("macrobatch_id") == macrobatch)


def save_results(results: DataFrame, path: str) -> None:
    """Label counts or metrics of a validation."""
    results.write.mode("overwrite").parquet(f"{path}/validation")


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/validation")
