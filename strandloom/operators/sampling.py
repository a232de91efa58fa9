"""Down-sampling, categorical draws, kernels, splits: all from stateless hash draws."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.functions.rng import draw, uniform

from . import ranges

#: Outcomes up to which they are broadcast to the rows that draw.
BROADCAST_OUTCOMES = 200_000


def keep_probability(prob: Column, t: float) -> Column:
    """sqrt(t / prob), at most 1; tokens without a probability are always kept."""
    return F.when(prob.isNull() | (prob <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.lit(t) / prob)))


def down_sample(rows: DataFrame, prob: Column, t: float, seed: int, *keys: Column) -> DataFrame:
    """Drops a row with probability 1 - sqrt(t / prob)."""
    return rows.where(uniform("discard", seed, *keys) >= 1 - keep_probability(prob, t))


def intervals(counts: DataFrame, key: str = "token") -> DataFrame:
    """counts with [lo, hi): the share of 0 .. total - 1 that each outcome owns, in order of key."""
    return ranges.with_running(counts, [F.col(key)], hi=F.col("count")).withColumn("lo", F.col("hi") - F.col("count"))


def draw_outcomes(rows: DataFrame, counts: DataFrame, tag: str, seed: int, *keys: Column, key: str = "token", outcome: str | None = None) -> DataFrame:
    """rows with an outcome drawn in proportion to counts: a range join by buckets of the cumulative counts, which are in order of key. The outcome is the key, or the column outcome of counts.

    There are as many buckets as outcomes, each met equally often, and every interval is listed under each bucket that it touches: about two to a
    bucket. So the join is an equi-join without hot keys; the outcomes are broadcast where their count is small.
    """
    total, outcomes = counts.where("count > 0").agg(F.sum("count"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("no outcome to draw")
    drawn = rows.withColumn("r", _never_null(F.pmod(draw(tag, seed, *keys), F.lit(int(total)))))
    return outcomes_at(drawn, intervals(counts.where("count > 0"), key), int(total), outcomes, outcome or key)


def _never_null(r: Column) -> Column:
    """A draw is never null, but Spark can't know: a join would test that in a filter of its own, which draws a second time."""
    return F.coalesce(r, F.lit(0))


def outcomes_at(drawn: DataFrame, spans: DataFrame, total: int, outcomes: int, key: str) -> DataFrame:
    """drawn with the outcome whose [lo, hi) holds r."""
    width = max(1, -(-total // max(64, outcomes)))
    spread = spans.select(F.col(key).alias("outcome"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bucket"))
    joined = drawn.withColumn("bucket", _never_null(F.floor(F.col("r") / width))).join(F.broadcast(spread) if outcomes <= BROADCAST_OUTCOMES else spread, "bucket")
    return joined.where((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).drop("bucket", "lo", "hi")


def draw_in_groups(rows: DataFrame, counts: DataFrame, tag: str, seed: int, *keys: Column, group: str = "group", key: str = "token") -> DataFrame:
    """rows with an outcome drawn in proportion to the counts of their own group; rows of a group without counts are left out.

    Groups own consecutive parts of one running sum, so the join is that of draw_outcomes.
    """
    own = counts.where("count > 0")
    spans = ranges.with_running(own, [F.col(group), F.col(key)], hi=F.col("count")).withColumn("lo", F.col("hi") - F.col("count"))
    groups = spans.groupBy(group).agg(F.min("lo").alias("_base"), F.sum("count").alias("_total"))
    total, outcomes, n_groups = *own.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first(), own.select(group).distinct().count()
    drawn = rows.join(F.broadcast(groups) if n_groups <= BROADCAST_OUTCOMES else groups, group)
    drawn = drawn.withColumn("r", _never_null(F.col("_base") + F.pmod(draw(tag, seed, *keys), F.col("_total")))).drop("_base", "_total")
    return outcomes_at(drawn, spans, int(total), outcomes, key)


def check_kernel(kernel: list[int]) -> int:
    """K of a kernel of 2K weights."""
    if not kernel or len(kernel) % 2:
        raise ValueError("a kernel has 2K weights")
    return len(kernel) // 2


def choose_offset(pos: Column, length: Column, kernel: list[int], r: Column) -> Column:
    """Offset of a context in a sentence: position pos (from 0) of length, the kernel cut at its ends, r an integer draw.

    The cumulative weights are literals; the choice is one CASE chain inside generated code.
    """
    k = check_kernel(kernel)
    offsets = [*range(-k, 0), *range(1, k + 1)]
    sums = [0, *accumulate(kernel)]
    start = F.greatest(F.lit(0), F.lit(k) - pos)
    stop = F.least(F.lit(2 * k), F.lit(k) + length - pos - 1)
    cumulative = F.array(*map(F.lit, sums))
    low, high = F.element_at(cumulative, (start + 1).cast("int")), F.element_at(cumulative, (stop + 1).cast("int"))
    target = low + F.pmod(r, F.greatest(high - low, F.lit(1)))
    out = F.when(high <= low, None)
    for i, offset in enumerate(offsets):
        out = out.when(target < sums[i + 1], offset)
    return out.cast("int")


def split(rows: DataFrame, p: float, seed: int, *keys: Column, tag: str = "split") -> DataFrame:
    """rows with is_train: true with probability p."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    return rows.withColumn("is_train", uniform(tag, seed, *keys) < p)


def hold_out_groups(rows: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, part): by hash order the first is ``test``, the second ``valid``, the rest ``train``."""
    groups = rows.select(group).distinct()
    two = groups.orderBy(draw("holdout", seed, F.col(group)), group).limit(2)  # groups are never ranked in one task
    first = two.withColumn("_rank", F.row_number().over(W.orderBy(draw("holdout", seed, F.col(group)), group))).select(F.col(group).alias("_g"), "_rank")
    named = groups.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_g")), "left")
    return named.select(group, F.when(F.col("_rank") == 1, "test").when(F.col("_rank") == 2, "valid").otherwise("train").alias("part"))


def choose(items: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n items by hash order."""
    return items.orderBy(draw("choose", seed, F.col(key)), key).limit(n)
