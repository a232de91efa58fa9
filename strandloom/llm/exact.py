"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first scan keeps (id, length, prefix hash). Lengths that occur once end there;
among the rest, (length, prefix hash) pairs that occur once end. Only what is left is read
and hashed in full. Counts are pre-aggregated before they are shuffled, and what is joined
to a hot length or hash is one row a key, so AQE can split its rows.

Defined results: null text is empty text; equal rows (also with equal ids) count
each, and all rows that carry the kept id and text are kept; null ids never win
against an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

#: Characters of the normalised text that the second step hashes.
PREFIX = 256


def normalised(text: str = "text") -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for every row, with text_sha256 of every row if digests."""
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    sized = norm.select("doc_id", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("ph"), "norm")
    heads = shared.stored(spark, sized.groupBy("n", "ph").agg(F.count(F.lit(1)).alias("c")), "heads")
    lengths = heads.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select("n")
    alive = heads.join(lengths, "n", "left_semi").where("c > 1").select("n", "ph", F.lit(True).alias("alive"))
    alive = shared.stored(spark, alive, "alive")
    full = F.unhex(F.sha2("norm", 256))
    if digests:
        rows = sized.select("doc_id", "n", "ph", full.alias("sha"))
        rows = shared.stored(spark, rows, "hashed").join(alive, ["n", "ph"], "left")
    else:
        if alive.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS:
            rows = sized.join(F.broadcast(alive), ["n", "ph"], "left").select("doc_id", "n", "ph", "alive", F.when(F.col("alive"), full).alias("sha"))
        else:  # hashing every text where it is read costs less than shuffling texts to their groups
            rows = shared.stored(spark, sized.select("doc_id", "n", "ph", full.alias("sha")), "all").join(alive, ["n", "ph"], "left")
        rows = shared.stored(spark, rows.select("doc_id", "n", "ph", "alive", "sha"), "hashed")
    once, again = rows.where(F.col("alive").isNull()), rows.where("alive")
    groups = again.groupBy("n", "sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = shared.stored(spark, groups, "groups")  # both sides of the join are then exchanges, which AQE can split
    joined = again.join(groups.withColumnRenamed("n", "gn").withColumnRenamed("sha", "gsha"), (F.col("n") == F.col("gn")) & (F.col("sha") == F.col("gsha")), "left")
    joined = joined.select("doc_id", F.when(F.col("gn").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha")
    both = joined.unionByName(once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    out = both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return out if digests else out.drop("text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest id, of rows that share id and text the least one.

    Rows are told by id and hash of the normalised text, so other texts of a repeated id stay.
    """
    spark, columns = docs.sparkSession, docs.columns
    key = [F.coalesce("doc_id", F.lit(0)).alias("_d"), F.xxhash64(F.col("doc_id").isNull(), "_sha").alias("_x")]
    rows = exact_groups(docs, digests=True).where("group_size > 1").select("doc_id", "kept", F.col("text_sha256").alias("_sha"))
    rows = shared.stored(spark, rows.select(*key, "kept").groupBy("_d", "_x").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("c")), "copies")
    keyed = docs.select("*", F.sha2(normalised(), 256).alias("_sha")).select(*columns, *key)
    out = shared.by_ids(keyed, rows.where("not kept").select("_d", "_x"), "left_anti", ["_d", "_x"])
    again = rows.where("kept and c > 1").select("_d", "_x")
    if not again.isEmpty():
        one = shared.by_ids(out, again, "left_semi", ["_d", "_x"]).groupBy("_d", "_x").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
        return shared.by_ids(out, again, "left_anti", ["_d", "_x"]).select(*columns).union(one)
    return out.select(*columns)


#: For each row of documents: its group, told by the normalised text itself.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
