"""Signal and noise examples, macrobatches, minibatches.

A token table is (sent, pos, length, token); neighbours are reached by window functions over one ordering, so a
very long sentence needs no array in memory and no self-join. A sentence of more than ranges.CHUNK tokens is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.functions.rng import draw

from . import ranges, sampling


def positions(rows: DataFrame, sentence: str, order: list[str], token: str, chunk: int = ranges.CHUNK) -> DataFrame:
    """(sent, pos, length, token) from one row a token."""
    named = rows.select(F.col(sentence).alias("sent"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(token).alias("token"))
    return ranges.placed(named, "sent", [F.col(f"_o{k}") for k in range(len(order))], chunk).select("sent", "pos", "length", "token")


def _neighbours(tokens: DataFrame, offsets: list[int], chunk: int) -> DataFrame:
    """tokens with _n0, _n1, ..: the tokens at the offsets, null beyond the sentence."""
    w = W.partitionBy("sent", "_chunk").orderBy("pos")
    at = [(F.lead if o > 0 else F.lag)("token", abs(o)).over(w).alias(f"_n{k}") for k, o in enumerate(offsets)]
    seen = ranges.in_chunks(tokens, max(0, -min(offsets)), max(0, *offsets), chunk).select("*", *at)
    return seen.where("_own").drop("_own", "_chunk")


def long_enough(rows: DataFrame, tokens: Column, minimum: int = 2) -> DataFrame:
    """rows with the length of their sentence, without those of fewer tokens: a lone token has no context."""
    return rows.withColumn("length", F.size(tokens)).where(F.col("length") >= minimum)


def with_context(tokens: DataFrame, kernel: list[int], seed: int, minimum: int = 2, chunk: int = ranges.CHUNK) -> DataFrame:
    """tokens of sentences of at least minimum tokens, with offset and context drawn by the kernel."""
    k = sampling.check_kernel(kernel)
    near = [*range(-k, 0), *range(1, k + 1)]
    named = _neighbours(tokens.where(F.col("length") >= minimum), near, chunk)
    drawn = named.withColumn("_r", draw("context", seed, F.col("sent"), F.col("pos")))  # one column, which all branches of the choice read
    chosen = drawn.withColumn("offset", sampling.choose_offset(F.col("pos"), F.col("length"), kernel, F.col("_r"))).drop("_r")
    context = F.when(F.lit(False), None)
    for i, o in enumerate(near):
        context = context.when(F.col("offset") == o, F.col(f"_n{i}"))
    return chosen.withColumn("context", context).drop(*(f"_n{i}" for i in range(2 * k)))


def legal_contexts(tokens: DataFrame, k: int) -> DataFrame:
    """tokens with how many context positions lie within k."""
    return tokens.withColumn("n_contexts", (F.least(F.col("pos"), F.lit(k)) + F.least(F.col("length") - 1 - F.col("pos"), F.lit(k))).cast("int"))


def signal(tokens: DataFrame, vocab: DataFrame, kernel: list[int], t: float, seed: int, minimum: int = 2) -> DataFrame:
    """(sent, pos, query, context): ids after down-sampling and the kernel's choice."""
    total = vocab.agg(F.sum("count").alias("_total"))
    known = vocab.select("token", "id", "count").crossJoin(F.broadcast(total))  # one row
    pairs = with_context(tokens, kernel, seed, minimum).select("sent", "pos", F.col("token").alias("q"), F.col("context").alias("c"))
    pairs = pairs.join(known.select(F.col("token").alias("q"), F.col("id").alias("query"), (F.col("count") / F.col("_total")).alias("prob")), "q", "left")
    pairs = sampling.down_sample(pairs, F.col("prob"), t, seed, F.col("sent"), F.col("pos"))
    pairs = pairs.join(known.select(F.col("token").alias("c"), F.col("id").alias("context")), "c", "left")
    return pairs.select("sent", "pos", F.coalesce("query", F.lit(0)).alias("query"), F.coalesce("context", F.lit(0)).alias("context"))


def noise(examples: DataFrame, vocab: DataFrame, ratio: int, seed: int) -> DataFrame:
    """(sent, pos, draw, query, context): ratio draws from the unigram counts for each signal example."""
    draws = examples.select("sent", "pos", "query", F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("draw"))
    drawn = sampling.draw_outcomes(draws, vocab.select("token", "id", "count"), "noise", seed, F.col("sent"), F.col("pos"), F.col("draw"), outcome="id")
    return drawn.select("sent", "pos", "draw", "query", F.col("outcome").alias("context"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rn from 1 in an order."""
    return ranges.ranked(rows, [F.col(c) for c in order], "rn")


def macrobatches(examples: DataFrame, size: int, order: list[str]) -> DataFrame:
    """(macrobatch_id, row_in_batch, query, context), the last filled up with (0, 0)."""
    rows = numbered(examples, order).select(F.floor((F.col("rn") - 1) / size).cast("int").alias("macrobatch_id"), ((F.col("rn") - 1) % size).cast("int").alias("row_in_batch"), "query", "context")
    return rows.unionByName(_padding(rows, size))


def _padding(rows: DataFrame, size: int) -> DataFrame:
    """The (0, 0) rows that the last macrobatch lacks."""
    last = rows.agg(F.max(F.struct("macrobatch_id", "row_in_batch")).alias("m")).where(F.col("m.row_in_batch") < size - 1)
    return last.select(F.col("m.macrobatch_id").alias("macrobatch_id"), F.explode(F.sequence(F.col("m.row_in_batch") + 1, F.lit(size - 1))).alias("row_in_batch"), F.lit(0).alias("query"), F.lit(0).alias("context"))


def with_noise(batched: DataFrame, vocab: DataFrame, ratio: int, seed: int, batch: str = "macrobatch_id") -> DataFrame:
    """(batch, row_in_batch, draw, query, context, is_signal): draw 0 is the signal, and ratio noise rows follow each signal row, padding too.

    Noise contexts are drawn from the unigram counts, keyed by batch, row and draw.
    """
    signal = batched.select(batch, "row_in_batch", F.lit(0).alias("draw"), "query", "context", F.lit(True).alias("is_signal"))
    draws = batched.select(batch, "row_in_batch", "query", F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("draw"))
    drawn = sampling.draw_outcomes(draws, vocab.select("token", "id", "count"), "batch-noise", seed, F.col(batch), F.col("row_in_batch"), F.col("draw"), outcome="id")
    noise_rows = drawn.select(batch, "row_in_batch", "draw", "query", F.col("outcome").alias("context"), F.lit(False).alias("is_signal"))
    return signal.unionByName(noise_rows)


def minibatches(examples: DataFrame, size: int, order: list[str], incomplete: str = "keep") -> DataFrame:
    """examples with batch_id and row_in_batch; an incomplete last batch is kept, dropped or padded with (0, 0)."""
    if incomplete == "pad":
        return macrobatches(examples, size, order).withColumnRenamed("macrobatch_id", "batch_id")
    rows = numbered(examples, order).select(F.floor((F.col("rn") - 1) / size).cast("int").alias("batch_id"), ((F.col("rn") - 1) % size).cast("int").alias("row_in_batch"), "query", "context")
    if incomplete == "drop":
        full = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size).select("batch_id")  # one row a batch
        rows = rows.join(full, "batch_id", "left_semi")
    return rows


def flank_noise(examples: DataFrame, flanks: DataFrame, ratio: int, seed: int) -> DataFrame:
    """(group, sent, pos, draw, query, context): noise of an example drawn from the flank tokens (group, context, count) of its own group, such as its chromosome.

    Examples of a group without flank tokens get no noise.
    """
    draws = examples.select("group", "sent", "pos", "query", F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("draw"))
    drawn = sampling.draw_in_groups(draws, flanks, "flank", seed, F.col("sent"), F.col("pos"), F.col("draw"), key="context")
    return drawn.select("group", "sent", "pos", "draw", "query", F.col("outcome").alias("context"))


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of two tables side by side: the n-th of each in its order. Rows beyond the shorter table are left out."""
    a, b = numbered(left, left_order), numbered(right, right_order)
    return a.join(b.withColumnRenamed("rn", "_rn"), F.col("rn") == F.col("_rn")).drop("_rn")


def skip_grams(tokens: DataFrame, window: int, skips: int, seed: int, chunk: int = ranges.CHUNK) -> DataFrame:
    """(sent, pos, token, context): ``skips`` distinct offsets within the window, without replacement, for inner positions."""
    offsets = [o for o in range(-window, window + 1) if o]
    inner = _neighbours(tokens, offsets, chunk).where((F.col("pos") >= window) & (F.col("pos") < F.col("length") - window))
    options = F.array(*(F.struct(draw("skip", seed, F.col("sent"), F.col("pos"), F.lit(o)).alias("h"), F.lit(o).alias("offset"), F.col(f"_n{k}").alias("context")) for k, o in enumerate(offsets)))
    picked = inner.select("sent", "pos", "token", F.explode(F.slice(F.array_sort(options), 1, skips)).alias("p"))
    return picked.select("sent", "pos", "token", F.col("p.offset").alias("offset"), F.col("p.context").alias("context"))
