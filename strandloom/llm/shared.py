"""What several operators use: shared-folder tables, bounded broadcasts, components."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.sources.scratch import discard, shared_dir, stored  # noqa: F401 - the operators take them from here

#: Rows of a narrow id table up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text that an operator works on at a time.
RUN_BYTES = 2 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the actions inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold at most BATCH_BYTES, or one longer row. A plan runs after its operator has returned, so the setting stays; it is only ever lowered."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def runs(texts: pa.Array):
    """(start, stop) of runs of rows that hold at most RUN_BYTES, or of one longer row.

    An Arrow batch is bounded by bytes (bound_batches); what an operator makes of its texts is bounded by going run by run.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes + 64), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RUN_BYTES, "right")))
        yield start, stop
        start = stop


def by_runs(function):
    """An Arrow function of a text column, called run by run."""

    def whole(texts: pa.Array) -> pa.Array:
        parts = [function(texts.slice(a, b - a)) for a, b in runs(texts)]
        return pa.concat_arrays(parts) if parts else function(texts)

    return whole


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the fold of a row."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, label, text) of at most per_class rows for label 0 and 1 each, outside the held-out fold.

    Ids are chosen from labels alone, by hash order, so the joined side is bounded by 2 * per_class rows; of a repeated id the least text counts.
    """
    base = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", modulus) != held))
    base = base.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = base.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join of wide docs on a narrow id table: broadcast where a count shows that it is small."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def by_ids_join(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inner join of wide docs with a narrow id table, broadcast where a count shows that it is small."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Stored (node, root) for every node of edges (a, b): root is the smallest node of its connected component.

    Alternates large-star and small-star steps until the edges are stars; every step is an aggregation and an equi-join
    that AQE can split where a node has very many neighbours. Nothing but an answer, stars or not, reaches the driver.
    """
    now = stored(spark, edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        low = stored(spark, low, "low")  # both join sides are then exchanges, which AQE can split
        large = both.join(low, both.a == low.n).where(both.b > both.a).select(both.b.alias("a"), low.m.alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = stored(spark, large, "large")
        least = stored(spark, large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "low")
        kept = large.join(least, large.a == least.n)
        small = kept.select(large.b.alias("a"), least.m.alias("b")).union(least.select("n", "m")).where(F.col("a") != F.col("b")).distinct()
        small = stored(spark, small, "small")
        for done in (now, low, large, least):
            discard(spark, done)
        now = small
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    out = stored(spark, now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")
    discard(spark, now)
    return out
