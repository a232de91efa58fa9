"""Losses, neighbours, pooling, histograms, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from strandloom.functions import rng
from strandloom.functions.vectors import euclidean

from . import cells

#: Rows (sentence, token) that a projection holds at a time in a task, and tokens whose draws it holds at a time.
PAIRS, TOKENS = 1 << 23, 1 << 13


def scores(pairs: DataFrame, queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """pairs (query, context) with dot and score = sigmoid(dot); queries are (id, w), contexts (id, c)."""
    from strandloom.functions.vectors import dot, sigmoid

    both = pairs.join(queries.select(F.col("id").alias("query"), "w"), "query").join(contexts.select(F.col("id").alias("context"), "c"), "context")
    return both.withColumn("dot", dot(F.col("w"), F.col("c"))).withColumn("score", sigmoid(F.col("dot"))).drop("w", "c")


def contrastive_loss(scored: DataFrame, scale: bool = True) -> DataFrame:
    """One row: -(sum log s over signal + sum log(1 - s) over noise), over the signal rows if scale."""
    term = F.when(F.col("is_signal"), F.log("score")).otherwise(F.log1p(-F.col("score")))
    loss = -F.sum(term)
    return scored.agg((loss / F.sum(F.col("is_signal").cast("int")) if scale else loss).alias("loss"))


def nearest(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "v", include_self: bool = True, digits: int = 6) -> DataFrame:
    """(query, neighbour, rank, similarity, score): exact cosine top-k of a stated query set against all rows.

    Both sides are counted and dealt to a grid of cells (see cells); a cell keeps its own k best of each query before anything is shuffled. score is 1 - d / 2 with the
    angular distance d.
    """
    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv"))
    i = index.select(F.col(id_col).alias("neighbour"), F.col(vec_col).alias("iv"))
    found = cells.best_matches(*cells.grid(q, i, q.count(), i.count()), ["_q", "_i"], k, include_self, digits)
    order = [F.desc("similarity"), F.col("neighbour")]
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("similarity"))))
    return best.select("query", "neighbour", "rank", "similarity", F.round(1 - distance / 2, digits).alias("score"))


def lsh_neighbours(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "v", bucket: float = 2.0, tables: int = 8, distance: float = 1.4, seed: int = 42) -> DataFrame:
    """(query, neighbour, distance, rank): approximate top-k by bucketed random projections of unit vectors.

    Rows of a bucket meet in cells (see cells), large buckets in several, so that no pair is a row before it is among a query's best of a bucket.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = Normalizer(inputCol="_v", outputCol="features")
    prepared = lambda d: unit.transform(d.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v")))
    a, b = prepared(index), prepared(queries)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(a)
    hashed = lambda d: model.transform(d).select("id", "v", F.posexplode("hashes").alias("_t", "_h")).select("id", "v", "_t", vector_to_array("_h")[0].cast("long").alias("_b"))
    rows, asked = hashed(a), hashed(b)
    parts = rows.groupBy("_t", "_b").agg(F.ceil(F.count(F.lit(1)) / cells.PART).cast("int").alias("_n"))
    dealt = rows.join(parts, ["_t", "_b"]).select("_t", "_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("_i"), F.col("id").alias("neighbour"), F.col("v").alias("iv"))
    copied = asked.join(parts, ["_t", "_b"]).select("_t", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"), F.col("id").alias("query"), F.col("v").alias("qv"))
    found = cells.best_matches(copied, dealt, ["_t", "_b", "_i"], k, within=distance).groupBy("query", "neighbour").agg(F.min("distance").alias("distance"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def mean_pool(rows: DataFrame, group: str, vec_col: str) -> DataFrame:
    """(group, dim, value): the mean of each dimension."""
    return rows.select(group, F.posexplode(vec_col).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def as_arrays(long_form: DataFrame, group: str) -> DataFrame:
    """(group, v) from (group, dim, value); a group has one row a dimension."""
    return long_form.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("v"))


def center(rows: DataFrame, vec_col: str) -> DataFrame:
    """(dim, value): the mean vector of all rows."""
    return rows.select(F.posexplode(vec_col).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def distance_to_center(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, distance) to the mean vector, which is one row."""
    middle = as_arrays(center(rows, vec_col).withColumn("g", F.lit(0)), "g").select(F.col("v").alias("_m"))
    return rows.crossJoin(F.broadcast(middle)).select(id_col, euclidean(F.col(vec_col), F.col("_m")).alias("distance"))  # one row


def density_histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, density): equal bins from the least to the largest value, the last one closed."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (F.first("total") * F.first(width))).alias("density"))


def random_projection(counts: DataFrame, sentence: str, token: str, n: str, dims: int, seed: int, dealt: bool = False) -> DataFrame:
    """(sentence, dim, value): sums of counts times normal draws keyed by token and dimension (Box-Muller).

    Rows are dealt by sentence and sorted by it; dealt says that those of a sentence are in one partition already, one after the other. A task makes the draws of a token once for each PAIRS of its rows, so neither draws nor a token's share
    of a sentence are shuffled: only the sentences' own sums are, as few of them lie in two such blocks.
    """
    there = counts.where(F.col(token).isNotNull() & F.col(n).isNotNull()).select(sentence, F.col(token).cast("string").alias("_t"), F.col(n).cast("double").alias("_n"))
    rows = there if dealt else there.repartition(sentence).sortWithinPartitions(sentence)
    summed = rows.mapInArrow(lambda batches: _projected(batches, sentence, dims, seed), f"`{sentence}` {counts.schema[sentence].dataType.simpleString()}, _v array<double>")
    wide = summed.groupBy(sentence).agg(*((F.sum(F.col("_v")[k]) / F.sqrt(F.lit(float(dims)))).alias(f"_{k}") for k in range(dims)))
    return wide.select(sentence, F.posexplode(F.array(*(F.col(f"_{k}") for k in range(dims)))).alias("dim", "value"))


def _projected(batches: Iterator[pa.RecordBatch], sentence: str, dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(sentence, _v): the sums of (sentence, _t, _n), in blocks of about PAIRS rows. Equal sentences come one after the other."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += max(batch.num_rows, batch.nbytes // 64)  # long tokens count for more
        if size >= PAIRS:
            yield from _project_block(pa.Table.from_batches(held), sentence, dims, seed)
            held, size = [], 0
    if size:
        yield from _project_block(pa.Table.from_batches(held), sentence, dims, seed)


def _project_block(block: pa.Table, sentence: str, dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    runs = pc.run_end_encode(pa.concat_arrays(block.column(sentence).chunks))
    names, ends = runs.values, runs.run_ends.to_numpy()
    place = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    coded = block.column("_t").cast(pa.large_binary()).combine_chunks().dictionary_encode()
    code, tokens, n = coded.indices.to_numpy(), coded.dictionary, block.column("_n").to_numpy()
    sums = np.zeros((len(ends), dims))
    part = code // TOKENS
    order = np.argsort(part, kind="stable")  # by parts of the tokens, within one still by sentence
    bounds = np.searchsorted(part[order], np.arange(-(-len(tokens) // TOKENS) + 1))
    for p, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        keys = tokens.slice(p * TOKENS, TOKENS).to_pylist()
        u, v = (rng.uniforms(tag, seed, keys, dims) for tag in ("proj-u", "proj-v"))
        normals = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)
        for first in range(lo, hi, TOKENS):
            at = order[first : min(hi, first + TOKENS)]
            starts = np.flatnonzero(np.diff(place[at], prepend=-1))
            sums[place[at[starts]]] += np.add.reduceat(normals[code[at] - p * TOKENS] * n[at][:, None], starts, axis=0)
    for lo in range(0, len(ends), 1024):
        v = sums[lo : lo + 1024]
        yield pa.RecordBatch.from_arrays([names.slice(lo, 1024), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dims, dtype=np.int32), v.reshape(-1))], [sentence, "_v"])


def principal_components(rows: DataFrame, id_col: str, vec_col: str, k: int = 3) -> DataFrame:
    """(id, dim, value): centred rows on the first k components; the sign of each is free."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = rows.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(raw).transform(raw)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.select(id_col, F.posexplode(vector_to_array("_p")).alias("dim", "value"))
