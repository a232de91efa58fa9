"""Approximate neighbours: a forest of random-projection trees.

All nodes of a tree's level share one random direction, and each node splits at the median of its rows' projections. Cuts are fitted on a sample by hash of at most about SAMPLE
vectors, a task a tree; then every vector goes down all trees in one pass. A query goes down the same cuts and meets the rows of its leaf in each tree in cells (see cells), where
they are ranked by exact cosine similarity. Where a tree has no more leaves than there are trees, a cell is a part of the queries and a part of the index, and one task goes through their leaves
in all trees: vectors are copied once for each part of the other side. Otherwise a cell is a leaf, and large leaves are several. Equal vectors are one row of the index and one query, so no leaf is
full of copies that no cut can part; the k least ids of each come back in the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandloom.sources.scratch import stored

from . import cells

#: Rows of a leaf that the depth aims at.
LEAF = 32
#: Vectors that the cuts are fitted on.
SAMPLE = 50_000


@dataclass
class Forest:
    """vectors (key, first, v, n), first being the least id and n a number in order of first; members (key, id), leaves (key, tree, node), cuts of each level (an array of trees x nodes)."""

    vectors: DataFrame
    members: DataFrame
    leaves: DataFrame
    cuts: list[np.ndarray]
    directions: np.ndarray


def _units(v: pa.Array) -> np.ndarray:
    """Unit vectors; a zero vector stays at zero."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def _fitted(sample: DataFrame, directions: np.ndarray) -> list[np.ndarray]:
    """Cuts of each level; a node without rows is cut at 0."""
    depth, trees, _ = directions.shape

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        p = _units(pa.concat_arrays(rows.column("v").chunks)) @ directions[:, tree].T
        node, levels, nodes, cuts = np.zeros(len(p), np.int64), [], [], []
        for level in range(depth):
            order = np.lexsort((p[:, level], node))
            names, starts, sizes = np.unique(node[order], return_index=True, return_counts=True)
            found = p[order[starts + (sizes - 1) // 2], level]
            levels += [level] * len(names)
            nodes.append(names)
            cuts.append(found)
            node = 2 * node + (p[:, level] > found[np.searchsorted(names, node)])
        return pa.table({"tree": pa.array([tree] * len(levels), pa.int32()), "level": pa.array(levels, pa.int32()), "node": np.concatenate(nodes), "cut": np.concatenate(cuts)})

    spread = sample.select("v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    out = [np.zeros((trees, 1 << level)) for level in range(depth)]
    for r in spread.groupBy("tree").applyInArrow(fit, "tree int, level int, node long, cut double").collect():  # fewer than the sample's rows a tree
        out[r.level][r.tree, r.node] = r.cut
    return out


def _nodes(units: np.ndarray, cuts: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """The leaf in each tree of unit vectors. Projections are rounded: the row that a cut was taken from falls to the same side in every task."""
    depth, trees, _ = directions.shape
    node, at = np.zeros((len(units), trees), np.int64), np.arange(trees)[None, :]
    for level in range(depth):
        node = 2 * node + (np.round(units @ directions[level].T, 9) > np.round(cuts[level][at, node], 9))
    return node


def _leaves(rows: DataFrame, cuts: list[np.ndarray], directions: np.ndarray, vec_col: str = "v") -> DataFrame:
    """rows with tree and node, once a tree: the leaf of their vector."""
    trees, dims = directions.shape[1:]

    def run(v: pa.Array) -> pa.Array:
        node = _nodes(_units(v) if len(v) else np.zeros((0, dims)), cuts, directions)
        return pa.ListArray.from_arrays(np.arange(0, (len(v) + 1) * trees, trees, dtype=np.int32), pa.array(node.reshape(-1)))

    node = F.arrow_udf(run, "array<long>")(F.col(vec_col))
    return rows.withColumn("_n", node).select("*", F.posexplode("_n").alias("tree", "node")).drop("_n")


def build(index: DataFrame, id_col: str = "id", vec_col: str = "v", trees: int = 30, leaf: int = LEAF, seed: int = 42, levels: int | None = None) -> Forest:
    """Trees with leaves of about leaf rows, or with no more than so many levels: vectors without structure need leaves that grow with the index for one recall."""
    spark = index.sparkSession
    named = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    named = named.withColumn("key", F.sha2(F.to_json("v"), 256))
    members = stored(spark, named.select("key", "id"), "members")
    vectors = stored(spark, named.groupBy("key").agg(F.min("id").alias("first"), F.any_value("v").alias("v")).orderBy("first", "key").withColumn("n", F.monotonically_increasing_id()), "vectors")
    size, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    depth = max(0, ceil(log2(max(1, min(size, SAMPLE * leaf)) / leaf)))
    depth = depth if levels is None else min(depth, levels)
    directions = np.random.default_rng(seed).normal(size=(depth, trees, dims or 1))
    sample = vectors.where(F.pmod(F.xxhash64("key"), F.lit(size)) < SAMPLE) if size > SAMPLE else vectors
    cuts = _fitted(sample, directions) if depth else []
    return Forest(vectors, members, _leaves(vectors, cuts, directions).select("key", "tree", "node"), cuts, directions)


def search(forest: Forest, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "v", include_self: bool = True, digits: int = 6) -> DataFrame:
    """(query, neighbour, rank, similarity): the best k among what the query meets in its leaves."""
    spark, most = queries.sparkSession, k if include_self else k + 1
    names = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv")).withColumn("key", F.sha2(F.to_json("qv"), 256))
    asked = stored(spark, names.groupBy("key").agg(F.any_value("qv").alias("qv")).withColumn("query", F.monotonically_increasing_id()), "asked")
    met = _met(forest, asked.select("query", "qv"), forest.vectors.select(F.col("n").alias("neighbour"), F.col("v").alias("iv")), most, digits)
    order = [F.desc("similarity"), F.col("neighbour")]
    best = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= most)
    least = forest.members.withColumn("_m", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("_m") <= most)
    least = least.join(forest.vectors.select("key", "n"), "key").select(F.col("n").alias("neighbour"), "id")
    near = best(best(met).join(least, "neighbour").select("query", F.col("id").alias("neighbour"), "similarity"))
    found = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("_n"))
    found = asked.select("key", "query").join(found, "query").select("key", "_n")
    kept = F.col("_n") if include_self else F.filter("_n", lambda x: x["neighbour"] != F.col("query"))
    rows = names.select("key", "query").join(found, "key").select("query", F.posexplode(F.slice(kept, 1, k)).alias("_p", "_r"))
    return rows.select("query", "_r.neighbour", (F.col("_p") + 1).alias("rank"), "_r.similarity")


def _met(forest: Forest, asked: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    """(query, neighbour, similarity) of distinct queries and rows: each pair once, the best k of each query and cell."""
    cuts, directions, n_asked, n_rows = forest.cuts, forest.directions, asked.count(), rows.count()
    if 1 << len(cuts) <= directions.shape[1]:
        return cells.best_matches(*cells.grid(asked, rows, n_asked, n_rows), ["_q", "_i"], k, digits=digits, leaves=lambda units: _nodes(units, cuts, directions))
    parts_q, parts_i = (max(1, -(-n // (cells.PART << len(cuts)))) for n in (n_asked, n_rows))  # medians make leaves of about one size
    left = cells.copied(cells.dealt(_leaves(asked, cuts, directions, "qv"), "query", "_q", parts_q), "_i", parts_i)
    right = cells.copied(cells.dealt(_leaves(rows, cuts, directions, "iv"), "neighbour", "_i", parts_i), "_q", parts_q)
    return cells.best_matches(left, right, ["tree", "node", "_q", "_i"], k, digits=digits).groupBy("query", "neighbour").agg(F.max("similarity").alias("similarity"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n, recall): the share of the exact (query, neighbour, similarity) rows that were found, or matched by an equal similarity at their rank."""
    hit = exact.select("query", "rank", F.col("similarity").alias("_s")).join(found.select("query", "rank", F.col("similarity").alias("_f")), ["query", "rank"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce(F.col("_f"), F.lit(-2.0)) >= F.col("_s")).cast("double")).alias("recall"))
