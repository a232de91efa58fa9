"""The best k rows of an index for each query, found cell by cell: a cell is a part of the queries and a part of the index that meet, and only k rows a query leave it.

A cell's vectors are multiplied in blocks inside one task, so no pair of a query and a row is ever a row of a table. Whoever calls deals rows
to cells of at most PART rows a side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a side of a cell that the dealing aims at.
PART = 16_384
#: Queries and rows of the index that are multiplied at a time.
QUERIES, ROWS = 256, 4096
# Places in the order of similarity of what has none. SQL puts NaN (a vector of zeros) first and null last.
NAN, NULL = 2.0, -2.0


def _unit(v: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, which of them are of zeros, and which are null."""
    there = np.asarray(v.is_valid())
    given = v.filter(pa.array(there))
    if len(given) and set(np.unique(given.value_lengths().to_numpy(zero_copy_only=False))) != {dims}:
        raise ValueError("vectors differ in length")
    x = np.zeros((len(v), dims))
    x[there] = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(axis=1))
    zero = there & (norm == 0)
    return x / np.where(norm > 0, norm, 1.0)[:, None], zero, ~there


def _values(q: np.ndarray, index: np.ndarray, within: float | None, scale: float) -> np.ndarray:
    """Similarities times scale, or with within negative distances times scale, -inf beyond it."""
    s = q @ index.T
    if within is None:
        return s * scale
    d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (index * index).sum(axis=1)[None, :] - 2 * s, 0.0))
    return np.where(d <= within, -d * scale, -np.inf)


def _best(q: np.ndarray, index: np.ndarray, odd_q: tuple, odd_i: tuple, names: tuple | None, k: int, within: float | None, scale: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of index, value): the best k of each query by falling rounded value (see _values), then place in the index. Rows whose names are equal don't meet.

    Place and value go into one whole number, so equal values are told apart. After the first block of the index only what beats a query's k-th so far is looked at; with
    least, a rounded value for each query, from the first block on only what reaches it.
    """
    most = float(len(index))
    keys, at = [], []
    for lo in range(0, len(q), QUERIES):
        part = slice(lo, lo + QUERIES)
        n = len(q[part])
        best, floor = np.full((n, k), -np.inf), None if least is None else least[part] - 1
        for first in range(0, len(index), ROWS):
            cols = slice(first, first + ROWS)
            s = _values(q[part], index[cols], within, scale)
            if within is None and (odd_q[0][part].any() or odd_i[0][cols].any() or odd_q[1][part].any() or odd_i[1][cols].any()):
                s = np.where(odd_q[0][part][:, None] | odd_i[0][cols][None, :], NAN * scale, s)
                s = np.where(odd_q[1][part][:, None] | odd_i[1][cols][None, :], NULL * scale, s)
            if names is not None:
                s[names[0][part][:, None] == names[1][cols][None, :]] = -np.inf
            if floor is None:
                key = np.rint(s) * most + (most - 1 - np.arange(s.shape[1]))
                if s.shape[1] > k:
                    key = np.partition(key, s.shape[1] - k, axis=1)[:, -k:]
                best[:, : key.shape[1]] = key
            else:
                # of equal ones the first stay, so only a larger rounded value can come in
                row, col = np.nonzero(s > floor[:, None] + 0.25)
                if not len(row):
                    continue
                key = np.rint(s[row, col]) * most + (most - 1 - (col + first))
                rows, both = np.r_[np.repeat(np.arange(n), k), row], np.r_[best.reshape(-1), key]
                order = np.lexsort((-both, rows))
                rows, both = rows[order], both[order]
                best = both[np.arange(len(rows)) - np.searchsorted(rows, rows) < k].reshape(n, k)
            worst = best.min(axis=1)
            reached = np.where(np.isfinite(worst), np.floor(worst / most), -np.inf)
            floor = reached if floor is None else np.maximum(floor, reached)
        found = np.isfinite(best)
        keys.append(best[found])
        at.append(np.nonzero(found)[0] + lo)
    key = np.concatenate(keys)
    value = np.floor(key / most)
    return np.concatenate(at), (most - 1 - (key - value * most)).astype(np.int64), value


def _best_in_leaves(q: np.ndarray, index: np.ndarray, odd_q: tuple, odd_i: tuple, k: int, scale: float, leaves: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best, among the pairs that share a leaf in some tree. Trees follow each other, so each looks only for what reaches the k-th of those before it."""
    of_q, of_i = leaves(q), leaves(index)
    most = float(len(index))
    best = np.full((len(q), k), -np.inf)
    for tree in range(of_q.shape[1]):
        at_q, at_i = np.argsort(of_q[:, tree], kind="stable"), np.argsort(of_i[:, tree], kind="stable")
        nodes = np.intersect1d(of_q[:, tree], of_i[:, tree])
        bounds = [np.searchsorted(of[at, tree], nodes, side) for of, at in ((of_q, at_q), (of_i, at_i)) for side in ("left", "right")]
        for lo_q, hi_q, lo_i, hi_i in zip(*bounds, strict=True):
            a, b = at_q[lo_q:hi_q], at_i[lo_i:hi_i]
            worst = best[a].min(axis=1)
            least = np.where(np.isfinite(worst), np.floor(worst / most), -np.inf) if np.isfinite(worst).all() else None
            row, col, value = _best(q[a], index[b], [x[a] for x in odd_q], [x[b] for x in odd_i], None, k, None, scale, least)
            both = np.full((len(a), 2 * k), -np.inf)
            both[:, :k] = best[a]
            both[row, k + np.arange(len(row)) - np.searchsorted(row, row)] = value * most + (most - 1 - b[col])
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -np.inf  # met in an earlier tree
            best[a] = np.partition(both, k, axis=1)[:, k:]
    row, at = np.nonzero(np.isfinite(best))
    value = np.floor(best[row, at] / most)
    return row, (most - 1 - (best[row, at] - value * most)).astype(np.int64), value


def best_matches(queries: DataFrame, index: DataFrame, on: list[str], k: int, include_self: bool = True, digits: int = 6, order: list[str] | None = None, within: float | None = None, leaves: Callable | None = None) -> DataFrame:
    """(query, neighbour, similarity): for each cell, the best k of its index rows (on, neighbour, iv) for each of its queries (on, query, qv), by rounded cosine similarity, then in order of order.

    A query in several cells has k rows of each. Similarities of zero vectors are NaN, those of null vectors null. With within the third column is the distance of unit
    vectors, at most that, the nearest come first, and null vectors have none. leaves gives the leaf in each tree of unit vectors (an array of vectors x trees); with it, a
    query meets only those rows of its cell that share a leaf with it.
    """
    if leaves is not None and (within is not None or not include_self):
        raise ValueError("leaves go with neither within nor left out names")
    scale = 10.0**digits
    order = order or ["neighbour"]
    measure = "similarity" if within is None else "distance"
    types = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (index, "neighbour"))]

    def column(t: pa.Table, name: str) -> pa.Array:
        return pa.concat_arrays(t.column(name).chunks) if t.column(name).num_chunks else pa.array([], t.schema.field(name).type)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if within is not None:
            left, right = (t.filter(t.column(c).is_valid()) for t, c in ((left, "qv"), (right, "iv")))
        right = right.sort_by([(c, "ascending") for c in order])
        asked, names, qv, iv = column(left, "query"), column(right, "neighbour"), column(left, "qv"), column(right, "iv")
        if not len(asked) or not len(names):
            return pa.table({"query": asked.slice(0, 0), "neighbour": names.slice(0, 0), measure: pa.array([], pa.float64())})
        dims = max((n for v in (qv, iv) for n in v.drop_null().slice(0, 1).value_lengths().to_pylist()), default=0)
        (q, *odd_q), (i, *odd_i) = _unit(qv, dims), _unit(iv, dims)
        same = None if include_self else (asked.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False))
        row, col, value = _best(q, i, odd_q, odd_i, same, k, within, scale) if leaves is None else _best_in_leaves(q, i, odd_q, odd_i, k, scale, leaves)
        null = odd_q[1][row] | odd_i[1][col]
        nan = (odd_q[0][row] | odd_i[0][col]) & ~null & (within is None)
        out = np.abs(value / scale) if within is not None else np.where(nan, np.nan, value / scale)
        return pa.table({"query": asked.take(pa.array(row)), "neighbour": names.take(pa.array(col)), measure: pa.array(out, mask=null)})

    left, right = queries.select(*on, "query", "qv"), index.select(*on, *dict.fromkeys(["neighbour", *order]), "iv")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"query {types[0]}, neighbour {types[1]}, {measure} double")


def copied(rows: DataFrame, name: str, n: int) -> DataFrame:
    """rows once for each of n parts of the other side."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def dealt(rows: DataFrame, by: str, name: str, n: int) -> DataFrame:
    """rows in n parts by a hash."""
    return rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))


def grid(queries: DataFrame, index: DataFrame, n_queries: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """All queries against all rows: both sides with the cells (_q, _i) in which they meet. There are cells for all cores, as far as PART / 16 rows and more are in each."""
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    parts_q = max(1, -(-n_queries // PART))
    parts_i = max(1, -(-n_rows // PART), min(-(-2 * cores // parts_q), -(-n_rows // (PART // 16))))
    return copied(dealt(queries, "query", "_q", parts_q), "_i", parts_i), copied(dealt(index, "neighbour", "_i", parts_i), "_q", parts_q)
