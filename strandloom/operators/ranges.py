"""Running sums and dense ranks over a whole order, sorted in ranges: no task holds more than its range. Places, neighbours and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.sources.scratch import stored

#: Rows of a group up to which one window holds it whole; longer groups are dealt to ranges, and their windows to chunks of so many places.
CHUNK = 1 << 20
#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def with_running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with running sums, the row's own included: within each range, moved by the ranges before it.

    The ranged table is stored first, so that sums and offsets see the same ranges whatever is planned or recomputed later.
    """
    spark = rows.sparkSession
    ranged = stored(spark, rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{name}") for name, c in sums.items()))  # one row a range
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums))
    out = ranged.select("*", *(F.sum(c).over(inside).alias(f"_i_{name}") for name, c in sums.items())).join(F.broadcast(offsets), "_part")
    return out.select(*rows.columns, *((F.col(f"_i_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1; the order must tell all rows apart, or equal ones are placed in any order."""
    return with_running(rows, order, **{name: F.lit(1).cast("long")})


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def placed(rows: DataFrame, group: str, order: list[Column], chunk: int = CHUNK) -> DataFrame:
    """rows with pos, the place in their group from 0, and length, the group's rows; the order must tell a group's rows apart. Null is a group.

    Groups of up to chunk rows get both from one window. Of longer ones there are fewer than rows / chunk, so their names are few; their rows go in ranges of (group, order).
    """
    w = W.partitionBy(group)
    whole = lambda d: d.select("*", (F.row_number().over(w.orderBy(*order)) - 1).alias("pos"), F.count(F.lit(1)).over(w).cast("int").alias("length"))
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    long = stored(rows.sparkSession, sizes, "long-groups")
    if long.isEmpty():
        return whole(rows)
    names = _few(long)
    same = F.col(group).eqNullSafe(F.col("_g"))
    ranged = stored(rows.sparkSession, rows.join(names, same, "left_semi").repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))  # few: ranges and long groups together
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_p", "_g", before.alias("_before"), F.sum("_n").over(W.partitionBy("_g")).alias("_total"))
    inside = F.row_number().over(W.partitionBy("_part", group).orderBy(*order)) - 1
    dealt = ranged.withColumn("_inside", inside).join(_few(parts), (F.col("_part") == F.col("_p")) & same)
    dealt = dealt.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("int").alias("pos"), F.col("_total").cast("int").alias("length"))
    return whole(rows.join(names, same, "left_anti")).unionByName(dealt)


def in_chunks(rows: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """rows of placed with _chunk, their part of the group, and copies for the neighbouring parts that look so many places before or after themselves.

    A window over (group, _chunk) then sees all neighbours; what is no copy has _own. A group of one chunk gets no copies, and its rows needn't move again.
    """
    if max(before, after) > chunk:
        raise ValueError("a window reaches further than a chunk")
    at, inside, last = F.floor(F.col("pos") / chunk), F.col("pos") % chunk, F.floor((F.col("length") - 1) / chunk)
    ahead = F.when((inside >= chunk - before) & (at < last), at + 1)
    back = F.when((inside < after) & (at > 0), at - 1)
    dealt = rows.withColumn("_at", at).withColumn("_chunk", F.explode(F.array_compact(F.array(at, ahead, back))))
    return dealt.withColumn("_own", F.col("_chunk") == F.col("_at")).drop("_at")


def running_in_chunks(rows: DataFrame, group: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows of placed with the running sum of value over their group's places, the row's own included."""
    spark = rows.sparkSession
    summed = rows.withColumn("_c", F.floor(F.col("pos") / chunk)).withColumn("_v", value)
    inside = F.sum("_v").over(W.partitionBy(group, "_c").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = stored(spark, summed.withColumn("_i", inside), "chunks")
    # only long groups have more than one chunk: fewer rows than rows / chunk, twice
    totals = summed.where(F.col("length") > chunk).groupBy(F.col(group).alias("_g"), F.col("_c").alias("_k")).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(W.partitionBy("_g").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    offsets = _few(totals.select("_g", "_k", before.alias("_o")))
    out = summed.join(offsets, (F.col("_c") == F.col("_k")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn(name, F.col("_i") + F.coalesce("_o", F.lit(0))).drop("_c", "_v", "_i", "_g", "_k", "_o")
