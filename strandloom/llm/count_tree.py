"""R-trees over count vectors: which sets of shingles may be similar.

The shingles of a set are hashed into groups, and the counts of the groups are its point. The overlap of two sets is at most the sum of
the lesser counts, group by group, and that of two boxes of points at most the same sum over their upper corners. A point has between half as many
groups as its set has shingles and as many, a power of two, so points of other sizes are compared after folding the finer one; boxes are compared in
the coarsest.

One tree over all documents would prune little: at a similarity of 0.8 every point's reach is two ninths of its size, further than the boxes of
unrelated sets lie apart in any few coordinates, so each query would visit every leaf. So the top of the tree branches on single rare
shingles: a branch holds the sets that have one shingle in the part of them that any similar set must meet (the rarest n - ceil(0.8 n) + 1), and below
it stands a tree of boxes. Any two similar sets share a branch. Branches with equal members are one.

Groups of near copies are contracted first. In a round each set goes to PICKS of its branches, those with the least hash in this round, which sets with
nearly the same branches choose alike; there it looks for its most promising partner in another component, links are verified and
components joined. So a round is linear in a group of copies. Branches and pairs of boxes that one component fills are left alone. When a round
links nothing, all pairs of components that boxes and points allow are verified, those of two components in turns until they are joined or have none left.
A branch of more than LEAVES points is dealt to several tasks, anew in each round, in the end each part with each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

#: Points of a branch that one task holds, points of a leaf box, boxes of a box.
LEAVES, LEAF, FAN = 1024, 16, 8
#: Branches that a set goes to in a round.
PICKS = 2
#: Groups of the coarsest and of the finest points.
COARSE, FINE = 32, 1 << 14
#: Pairs of points that are compared at a time.
AT_ONCE = 1 << 14
#: Hash values by which pairs of components take turns.
SHARES = 4096


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in a power of two of groups."""
    groups = COARSE
    while 2 * groups <= len(shingles) and groups < FINE:
        groups *= 2
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """The width of a count in bytes, then the counts."""
    kind = np.uint8 if counts.max() < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1).astype(np.int32)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) with so many groups: what the shingles' hashes would have given."""
    return points.reshape(len(points), -1, groups).sum(axis=1)


def needed(na, nb, similarity: float):
    """The least overlap of two sets of the similarity."""
    return np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9)


class Tree:
    """Boxes over points of the coarsest groups: leaves of LEAF points, made by halving at the widest coordinate, and FAN boxes to each above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        of, count = np.unique(roots, return_inverse=True, return_counts=True)[1:]
        own = count >= LEAF  # large components get boxes of their own
        group = np.where(own[of], of, -1)
        order = np.argsort(group, kind="stable")
        parts, stack = [], np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                parts.append(part)
                continue
            both = np.c_[points[part], sizes[part]]
            wide = np.argmax(both.max(axis=0) - both.min(axis=0))
            part = part[np.argsort(both[:, wide], kind="stable")]
            stack += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order = np.concatenate(parts)
        starts = np.cumsum([0, *(len(p) for p in parts)])
        self.levels = [self._boxes(starts, points[self.order], sizes[self.order], roots[self.order], roots[self.order])]
        while len(self.levels[-1][0]) > 2:
            _, high, *rest = self.levels[-1]
            self.levels.append(self._boxes(np.r_[np.arange(0, len(high), FAN), len(high)], high, *rest))

    @staticmethod
    def _boxes(starts, high, least, r0, r1):
        """(starts, upper corners, least size, least and largest root)."""
        at = starts[:-1]
        return starts, np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at), np.minimum.reduceat(r0, at), np.maximum.reduceat(r1, at)

    def leaf_pairs(self, similarity: float):
        """Pairs of leaves u <= v whose boxes allow the similarity, from the top down."""
        u = v = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            _, high, least, r0, r1 = self.levels[k]
            several = (r0[u] != r1[u]) | (r0[v] != r1[v]) | (r0[u] != r0[v])
            u, v = u[several], v[several]
            keep = np.concatenate([np.minimum(high[u[i : i + AT_ONCE]], high[v[i : i + AT_ONCE]]).sum(axis=1) for i in range(0, len(u), AT_ONCE)]) if len(u) else np.empty(0)
            keep = keep >= needed(least[u], least[v], similarity)
            u, v = u[keep], v[keep]
            if k:
                u, v = _children(u, v, self.levels[k][0])
                u, v = u[u <= v], v[u <= v]
        return u, v


def _children(u: np.ndarray, v: np.ndarray, starts: np.ndarray):
    """All pairs of what the boxes of each pair hold."""
    nu, nv = starts[u + 1] - starts[u], starts[v + 1] - starts[v]
    total = nu * nv
    of = np.repeat(np.arange(len(u)), total)
    k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
    return starts[u][of] + k // nv[of], starts[v][of] + k % nv[of]


def close_pairs(roots: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], side: np.ndarray | None, similarity: float):
    """Yields (a, b, bound) of places whose roots differ and whose points allow the similarity; with sides, only those of two sides."""
    grain = np.array([len(p) for p in points])
    coarse = np.array([p.reshape(-1, COARSE).sum(axis=0) for p in points])
    finer = {int(g): folded(np.array([points[i] for i in np.flatnonzero(grain == g)]), int(g)) for g in np.unique(grain)}
    row = np.zeros(len(points), np.int64)
    for g in finer:
        row[grain == g] = np.arange(len(finer[g]))
    tree = Tree(coarse, sizes, roots)
    u, v = tree.leaf_pairs(similarity)
    step = max(1, AT_ONCE // (LEAF * LEAF))
    for i in range(0, len(u), step):
        a, b = _children(u[i : i + step], v[i : i + step], tree.levels[0][0])
        a, b = tree.order[a[a < b]], tree.order[b[a < b]]
        fit = (roots[a] != roots[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9)
        if side is not None:
            fit &= side[a] != side[b]
        a, b = a[fit], b[fit]
        need = needed(sizes[a], sizes[b], similarity)
        fit = np.minimum(coarse[a], coarse[b]).sum(axis=1) >= need
        a, b, need = a[fit], b[fit], need[fit]
        bound = np.zeros(len(a))
        both = np.minimum(grain[a], grain[b])
        for g in np.unique(both):
            for here in np.array_split(np.flatnonzero(both == g), 1 + int((both == g).sum()) * int(g) // (1 << 22)):
                x, y = (_at_grain(finer, row[k[here]], grain[k[here]], int(g)) for k in (a, b))
                bound[here] = np.minimum(x, y).sum(axis=1)
        fit = bound >= need
        yield a[fit], b[fit], bound[fit] / (sizes[a[fit]] + sizes[b[fit]])


def _at_grain(finer: dict, rows: np.ndarray, grains: np.ndarray, g: int) -> np.ndarray:
    out = np.empty((len(rows), g), np.int32)
    for k in np.unique(grains):
        out[grains == k] = folded(finer[int(k)][rows[grains == k]], g)
    return out


def _branches(best: bool, similarity: float):
    """mapInArrow over (h, i, j, d, root, n, side, v) sorted by h, i, j: (a, b, c) with a < b, c how promising; of each point its best partner, or all."""

    def pairs(ids, roots, sizes, points, side):
        n = len(ids)
        top, partner = np.full(n, -1.0), np.full(n, -1)
        for a, b, c in close_pairs(roots, sizes, points, side, similarity):
            if not best:
                yield np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), c
                continue
            for x, y in ((a, b), (b, a)):
                order = np.lexsort((ids[y], -c, x))
                x, y, w = x[order], y[order], c[order]
                first = np.r_[True, x[1:] != x[:-1]][: len(x)]
                x, y, w = x[first], y[first], w[first]
                up = w > top[x]
                top[x[up]], partner[x[up]] = w[up], y[up]
        if best:
            x = np.flatnonzero(partner >= 0)
            y = partner[x]
            yield np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), top[x]

    def run(batches):
        key, held = None, []

        def done():
            d, root, n, side = (np.concatenate([x[k] for x in held]) for k in range(4))
            points = [unpacked(p) for x in held for p in x[4]]
            if len(np.unique(root)) > 1:
                for a, b, c in pairs(d, root, n, points, side if side.any() else None):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "c"])

        for got in batches:
            if not got.num_rows:
                continue
            h, i, j, d, root, n, side = (got.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for s, e in zip(new, [*new[1:], len(h)], strict=True):
                if key != (h[s], i[s], j[s]):
                    if held:
                        yield from done()
                    key, held = (h[s], i[s], j[s]), []
                held.append((d[s:e], root[s:e], n[s:e], side[s:e], got.column(7).slice(s, e - s).to_pylist()))
        if held:
            yield from done()

    return run


def _candidates(live: DataFrame, points: DataFrame, best: bool, turn: int, similarity: float) -> DataFrame:
    """(a, b, c) of live branches (h, d, n, root, g); parts of a large branch go alone, or each with each."""
    parts = F.ceil(F.col("g") / LEAVES).cast("int")
    mine = F.pmod(F.xxhash64("d", F.lit(turn)), parts).cast("int")
    if best:
        picks = [F.min(F.struct(F.xxhash64("h", F.lit(PICKS * turn + k)).alias("x"), "h", "g")).alias(f"p{k}") for k in range(PICKS)]
        own = live.groupBy("d", "root", "n").agg(*picks)
        picked = own.select("d", "root", "n", F.explode(F.array_distinct(F.array(*(F.struct(f"p{k}.h", f"p{k}.g") for k in range(PICKS))))).alias("b")).select("d", "root", "n", "b.h", "b.g")
        dealt = picked.select("h", mine.alias("i"), mine.alias("j"), "d", "root", "n", F.lit(0).alias("side"))
    else:
        other = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
        dealt = live.select("h", mine.alias("m"), parts.alias("p"), "d", "root", "n").select("h", "m", other.alias("o"), "d", "root", "n")
        dealt = dealt.select("h", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "d", "root", "n", F.when(F.col("m") == F.col("o"), 0).when(F.col("m") < F.col("o"), 1).otherwise(2).alias("side"))
    both = dealt.join(points.select("d", "v"), "d").select("h", "i", "j", "d", "root", "n", "side", "v")
    return both.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_branches(best, similarity), "a long, b long, c double")


def connected(spark: SparkSession, base: DataFrame, rare: DataFrame, roots: DataFrame, hashes, similarity: float) -> DataFrame:
    """Stored (node, root) after linking every two sets of the similarity: roots are those that are known to hold together already.

    base is (d, t), rare the stored (h, d, n, pos) of prefixes, hashes an Arrow function from texts to sorted distinct shingle hashes as bytes.
    """
    sig = rare.groupBy("h").agg(F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("y")).where("g > 1")
    branch = shared.stored(spark, sig.groupBy("g", "x", "y").agg(F.min("h").alias("h")).select("h", "g"), "branch")
    members = shared.stored(spark, rare.select("h", "d", "n").join(branch, "h"), "members")
    ids = shared.stored(spark, members.select("d").distinct(), "ids")
    sets = shared.by_ids(base, ids, "left_semi", "d").select("d", F.arrow_udf(shared.by_runs(hashes), "binary")("t").alias("s")).dropDuplicates(["d"])

    def points_of(s: pa.Array) -> pa.Array:
        return pa.array([packed(point(np.frombuffer(x.as_py(), np.uint64))) for x in s], pa.binary())

    points = shared.stored(spark, sets.select("d", "s", F.arrow_udf(points_of, "binary")("s").alias("v")), "points")

    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
        return pa.array(out, pa.bool_())

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.select("a", "b").join(points.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(points.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
        out = shared.stored(spark, both.where(F.arrow_udf(similar, "boolean")("sa", "sb")).select("a", "b"), "verified")
        shared.discard(spark, pairs)
        return out

    def joined(links: DataFrame) -> DataFrame:
        """roots after links: components of what the linked components are."""
        ends = links
        for x in "ab":
            ends = ends.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
        higher = shared.components(spark, ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        new = higher.select(F.col("node").alias("root"), F.col("root").alias("up"))
        kept = roots.join(new, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        out = shared.stored(spark, kept.union(higher.select("node", "root").join(roots.select("node"), "node", "left_anti")), "roots")
        for done in (links, roots, higher):
            shared.discard(spark, done)
        return out

    turn = 0
    while True:
        named = shared.stored(spark, members.join(roots.withColumnRenamed("node", "d"), "d", "left").select("h", "d", "n", "g", F.coalesce("root", "d").alias("root")), "named")
        mixed = shared.stored(spark, named.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("h"), "mixed")
        live = shared.stored(spark, named.join(mixed, "h"), "live")
        for done in (named, mixed):
            shared.discard(spark, done)
        if live.isEmpty():
            break
        found = _candidates(live, points, True, turn, similarity).select(F.explode(F.array(F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "c"))).alias("p")).select("p.*")
        best = found.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
        links = verified(shared.stored(spark, best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best"))
        if links.isEmpty():
            break
        roots = joined(links)
        shared.discard(spark, live)
        turn += 1
    if not live.isEmpty():
        pairs = shared.stored(spark, _candidates(live, points, False, turn, similarity).groupBy("a", "b").agg(F.max("c").alias("c")), "pairs")
        # one pair of each two components, then ever larger shares of the pairs of what is still apart
        left = _apart(spark, pairs, roots)
        first = F.max(F.struct("c", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")
        now = shared.stored(spark, left.groupBy("r0", "r1").agg(first).select((-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b")), "now")
        untried = shared.stored(spark, left.join(now, ["a", "b"], "left_anti"), "untried")
        for share in (SHARES // 64, SHARES // 8, SHARES, None):
            links = verified(now)
            if not links.isEmpty():
                roots = joined(links)
            if share is None:
                break
            left = _apart(spark, untried, roots)
            if left.isEmpty():
                break
            at = F.pmod(F.xxhash64("a", "b"), F.lit(SHARES))
            now, untried = shared.stored(spark, left.where(at < share).select("a", "b"), "now"), left.where(at >= share)
    for done in (branch, members, ids, points, live):
        shared.discard(spark, done)
    return roots


def _apart(spark: SparkSession, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored (a, b, c, r0, r1) of the pairs whose components differ, with these in order."""
    out = pairs.select("a", "b", "c")
    for x in "ab":
        out = out.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    return shared.stored(spark, out.where("ra != rb").select("a", "b", "c", F.least("ra", "rb").alias("r0"), F.greatest("ra", "rb").alias("r1")), "apart")
