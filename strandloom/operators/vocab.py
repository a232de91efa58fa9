"""Dictionaries: counts, ids, classes, pruning, look-ups.

A vocabulary is (token, canon, id, count); id 0 is UNK. canon is the token itself, or the name of its
reverse-complement class; tokens of a class share an id. Ids are ranks in a stated order, so they don't depend on how rows are dealt.
Ranks are made in ranges of the order (see ranges), so a vocabulary of any size is never in one task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from strandloom.functions.tokens import canonical

from . import ranges

UNK = "UNK"


def count_tokens(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, count): partial counts on each side of the shuffle."""
    return tokens.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("count"))


def dense_ids(keys: DataFrame, order: list[Column], first: int = 1) -> DataFrame:
    """keys with a dense id in the order."""
    return ranges.ranked(keys, order, "_rank").withColumn("id", (F.col("_rank") + (first - 1)).cast("int")).drop("_rank")


def build(counts: DataFrame, by: str = "token", reverse_complement: bool = False) -> DataFrame:
    """Ids for (token, count), UNK not counted: in order of token, of first sight (a column first), or of falling count."""
    orders = {"token": [F.col("canon")], "first": [F.col("_first"), F.col("canon")], "count": [F.desc("_total"), F.col("canon")]}
    if by not in orders:
        raise ValueError(f"no such order: {by}")
    named = counts.where(F.col("token") != UNK).withColumn("canon", canonical(F.col("token")) if reverse_complement else F.col("token"))
    first = F.min("first") if by == "first" else F.lit(None)
    classes = dense_ids(named.groupBy("canon").agg(first.alias("_first"), F.sum("count").alias("_total")), orders[by]).select("canon", "id")
    return named.join(classes, "canon").select("token", "canon", "id", F.col("count").cast("long").alias("count"))


def from_list(spark: SparkSession, tokens: list[str], reverse_complement: bool = False) -> DataFrame:
    """A vocabulary from tokens in their order, counts zero; UNK must come first and gets id 0. Later copies of a token or class share the first one's id."""
    if not tokens or tokens[0] != UNK:
        raise ValueError("the first token must be UNK")
    return from_listed(spark.createDataFrame([(t, k) for k, t in enumerate(tokens[1:])], "token string, place long"), reverse_complement)


def from_listed(listed: DataFrame, reverse_complement: bool = False) -> DataFrame:
    """from_list for a list of any length, (token, place); UNK gets id 0 wherever it stands."""
    rows = listed.where(F.col("token").isNotNull()).groupBy("token").agg(F.min("place").alias("first"))
    return with_unk(build(rows.withColumn("count", F.lit(0).cast("long")), "first", reverse_complement))


def with_unk(vocab: DataFrame, count: int = 0) -> DataFrame:
    """vocab with the row of UNK, id 0: what saved dictionaries begin with."""
    unk = vocab.sparkSession.createDataFrame([(UNK, UNK, 0, count)], "token string, canon string, id int, count long")
    return unk.unionByName(vocab.where(F.col("token") != UNK).select("token", "canon", "id", "count"))


def key_values(vocab: DataFrame, value: str = "id") -> DataFrame:
    """(token, value) in order of id, UNK first."""
    full = vocab if not vocab.where(F.col("token") == UNK).isEmpty() else with_unk(vocab)
    return full.orderBy("id", "token").select("token", value)


def prune(counts: DataFrame, min_frequency: int, mode: str = "token") -> DataFrame:
    """(token, count): what is rarer than min_frequency goes to UNK, whose own count starts anew.

    mode ``token`` looks at each token's count, ``class`` at its reverse-complement class's.
    """
    size = F.col("count") if mode == "token" else F.sum("count").over(W.partitionBy(canonical(F.col("token"))))
    sized = counts.where(F.col("token") != UNK).withColumn("_size", size)
    name = F.when(F.col("_size") >= min_frequency, F.col("token")).otherwise(UNK)
    return sized.select(name.alias("token"), "count").groupBy("token").agg(F.sum("count").alias("count"))


def dropped(counts: DataFrame, min_frequency: int) -> DataFrame:
    """One row: tokens that prune drops, and their mass."""
    rare = F.col("count") < min_frequency
    return counts.agg(F.count(F.when(rare, 1)).alias("n_dropped"), F.coalesce(F.sum(F.when(rare, F.col("count"))), F.lit(0)).alias("mass"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of counts, negative ones too."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("token").agg(F.sum("count").alias("count"))


def difference(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Tokens whose counts differ: (token, count_a, count_b)."""
    left, right = a.select("token", F.col("count").alias("count_a")), b.select("token", F.col("count").alias("count_b"))
    return left.join(right, "token", how).where(~F.col("count_a").eqNullSafe(F.col("count_b")))


def remove(vocab: DataFrame, tokens: list[str]) -> DataFrame:
    """Without some tokens; ids keep their gaps. UNK can't be removed, nor what isn't there."""
    if UNK in tokens:
        raise ValueError("UNK can't be removed")
    present = {r["token"] for r in vocab.where(F.col("token").isin(tokens)).select("token").collect()}
    if missing := sorted(set(tokens) - present):
        raise ValueError(f"not in the vocabulary: {missing}")
    return vocab.where(~F.col("token").isin(tokens))


def compact(vocab: DataFrame) -> DataFrame:
    """Ids without gaps, in their order."""
    dense = dense_ids(vocab.select(F.col("id").alias("_old")).distinct(), [F.col("_old")])
    return vocab.withColumnRenamed("id", "_old").join(dense, "_old").select(*vocab.columns)


def look_up(rows: DataFrame, vocab: DataFrame, token: str = "token", on_unknown: str = "silent", broadcast: bool = False) -> DataFrame:
    """rows with id and count of their token: 0 and 0 for unknown ones; ``warn`` counts them first and warns, ``error`` fails the job."""
    if on_unknown not in ("silent", "warn", "error"):
        raise ValueError(f"no such policy: {on_unknown}")
    if on_unknown == "warn":
        total, distinct = unknown_tokens(rows, vocab, token).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        if total:
            warnings.warn(f"{total} rows hold {distinct} unknown tokens", stacklevel=2)
    known = vocab.select(F.col("token").alias("_token"), F.col("id"), F.col("count"))
    out = rows.join(F.broadcast(known) if broadcast else known, F.col(token) == F.col("_token"), "left")
    none = F.raise_error(F.concat(F.lit("unknown token: "), F.col(token))).cast("int") if on_unknown == "error" else F.lit(0)
    unknown = F.col("_token").isNull()
    return out.withColumn("id", F.when(unknown, none).otherwise(F.col("id"))).withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).drop("_token")


def unknown_tokens(rows: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """(token, n) of tokens that the vocabulary lacks."""
    return rows.join(vocab.select(F.col("token").alias("_t")), F.col(token) == F.col("_t"), "left_anti").groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def probabilities(vocab: DataFrame) -> DataFrame:
    """vocab with prob = count over the total."""
    total = vocab.agg(F.sum("count").alias("_total"))
    return vocab.crossJoin(F.broadcast(total)).withColumn("prob", F.col("count") / F.col("_total")).drop("_total")  # one row


def decode(ids: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """ids with the least token of the id's class."""
    names = vocab.groupBy(F.col("id").alias("_id")).agg(F.min("token").alias("token"))
    return ids.join(names, F.col(id_col) == F.col("_id"), "left").withColumn("token", F.coalesce("token", F.lit(UNK))).drop("_id")


def top_with_rest(counts: DataFrame, n: int) -> DataFrame:
    """The n - 1 most frequent tokens, and UNK with the count of the rest."""
    top = counts.orderBy(F.desc("count"), "token").limit(n - 1)
    rest = counts.join(top.select("token"), "token", "left_anti").agg(F.lit(UNK).alias("token"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return top.unionByName(rest)


def dense_counts(outcomes: DataFrame, outcome: str) -> DataFrame:
    """(id, count) for every id from 0 to the largest."""
    spark = outcomes.sparkSession
    counted = outcomes.groupBy(F.col(outcome).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    top = counted.agg(F.max("id")).first()[0]
    ids = spark.range(0 if top is None else top + 1)
    return ids.join(counted, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("count"))
