"""Near-duplicate removal for word-shingle similarity: SimHash balls first, then an exact join on rare shingles.

Similarity 0.8 of five-word shingles moves a 64-bit SimHash of them by some ten bits, far outside a
ball of 3 bits. So documents get BLOCKS independent SimHashes of BITS bits over their words (the k-th occurrence
of a word counts where k is a square, which damps frequent words). Equal sketches are merged to their least document.
In every block each sketch emits all variants within half of 2, one bit, and meets the others there. Each
document then has one candidate: of the least documents of its buckets, the one that it meets most often. So the work is linear in a group of copies.

Balls contract groups of copies but lose pairs: a passage cut off or added moves many bits. So all documents that
the balls leave in different components go through their rarest shingles, of which
any two similar sets share one in their prefixes. Sets that share such a shingle meet in a tree of boxes (see count_tree), which contracts groups of copies in rounds
and in the end tries all pairs of components that its bounds allow.
Every link is verified by the exact Jaccard similarity of five-word shingle sets.

Defined results: null text is empty; texts without words equal each other; of each component the row with the smallest id stays, of a
repeated id the text with the least hash; rows with a null id stay; equal rows (id and text) stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import count_tree, shared
from .decontam import WordHashes, shingle_hashes
from .simhash import words_of

BLOCKS, BITS = 6, 42
#: 128-bit hashes of a mark that give a bit for each of BLOCKS * BITS.
DIGESTS = -(-BLOCKS * BITS // 128)
WIDTH = 5
SIMILARITY = 0.8
#: Shingles that one task of the exact join holds at a time, and the least number of ranges they are dealt to.
RANGE_SHINGLES, RANGES = 1 << 21, 1024
#: One document of so many tells which shingles are hot: in over one of HOT_SHARE documents, and in HOT_LEAST of those sampled.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 64, 10_000, 32
HOT = (1 << 32) - 1


def sketch(words: list[bytes]) -> list[int]:
    """BLOCKS SimHashes of BITS bits."""
    marks = [w if k == 1 else w + b" %d" % k for w, c in Counter(words).items() for k in range(1, isqrt(c) + 1)]
    if not marks:
        return [0] * BLOCKS
    bits = np.zeros(128 * DIGESTS, np.int64)
    for at in range(0, len(marks), 1 << 13):
        part = marks[at : at + (1 << 13)]
        raw = b"".join([xxhash.xxh3_128_digest(m, k) for m in part for k in range(1, DIGESTS + 1)])
        bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16 * DIGESTS), axis=1).sum(axis=0, dtype=np.int64)
    set_ = (2 * bits[: BLOCKS * BITS] > len(marks)).reshape(BLOCKS, BITS)
    return (set_ @ (1 << np.arange(BITS, dtype=np.int64))).tolist()


def shingle_set(words: list[bytes], known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words where there are fewer; of nothing, one that no shingle has."""
    if not words:
        return np.zeros(1, np.uint64)
    return np.unique(shingle_hashes(words, min(WIDTH, len(words)), known))


def _first_and_member(batches):
    """mapInArrow over rows (v, d) sorted so: (a, b) of the first and each further member of a bucket, with how often they meet here."""
    last_v, first = None, 0
    for got in batches:
        if not got.num_rows:
            continue
        v, d = (got.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        new = np.r_[last_v is None or v[0] != last_v, v[1:] != v[:-1]]
        starts = np.flatnonzero(new)
        a = np.r_[first, d[starts]][np.cumsum(new)]
        pairs, times = np.unique(np.stack([a, d], axis=1)[a != d], axis=0, return_counts=True)
        last_v, first = v[-1], a[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times)], names=["a", "b", "c"])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers by their significance, which shuffles compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _ids(d: np.ndarray) -> bytes:
    return _planes(np.diff(d, prepend=0))


def _needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of a set of n that any similar set has at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _spread_shingles(known: WordHashes, hot: np.ndarray, bits: int, similarity: float):
    """mapInArrow over (id, text): the ids and 32 further bits of all shingles of one value of the first bits, k.

    docs: ids, sizes, and how many shingles don't travel, in one row of a run. Hot shingles come last in the order of all shingles, so they travel only
    where a document has so many that its prefix reaches them; with a random part beside k, as they need no counting.
    """

    def run(batches):
        for got in batches:
            texts = got.column(1).cast(pa.binary())
            for start, stop in shared.runs(texts):
                d = got.column(0).slice(start, stop - start).to_numpy(zero_copy_only=False)
                first = np.argsort(d, kind="stable")
                d = d[first]
                sets = [shingle_set(words_of(texts[start + int(i)].as_py() or b""), known) for i in first]
                n = np.array([len(s) for s in sets])
                h, at = np.concatenate(sets), np.repeat(np.arange(len(d)), n)
                late = np.isin(h, hot, kind="sort") if len(hot) else np.zeros(len(h), bool)
                n_late = np.bincount(at[late], minlength=len(d))
                reach = n_late >= _needed(n, similarity)
                skipped = np.where(reach, 0, n_late)
                rows = []
                for part, pick in ((0, ~late), (1 + int(d[0]) % 1024, late & reach[at])):
                    k, low, of = (h[pick] >> np.uint64(64 - bits)).astype(np.int64), (h[pick] >> np.uint64(32 - bits)).astype(np.uint32), d[at[pick]]
                    order = np.argsort(k, kind="stable")
                    k, low, of = k[order], low[order], of[order]
                    cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist() if len(k) else []
                    rows += [(int(k[i]), part, _ids(of[i:j]), low[i:j].tobytes(), None) for i, j in zip(cuts, [*cuts[1:], len(k)], strict=bool(cuts))] if cuts else []
                turn = int(d[0]) % max(1, len(rows))  # not always the same task's
                docs = d.tobytes() + n.astype(np.int64).tobytes() + skipped.astype(np.int64).tobytes()
                if rows:
                    rows[turn] = (*rows[turn][:4], docs)
                else:
                    rows = [(int(d[0]) % (1 << bits), 0, b"", b"", docs)]
                k, part, ids, low, docs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(part, pa.int32()), pa.array(ids, pa.binary()), pa.array(low, pa.binary()), pa.array(docs, pa.binary())], names=["k", "part", "ids", "low", "docs"])

    return run


def _common_shingles(ranges: int):
    """applyInArrow for one (k, part): shingles of several documents with their counts, by ranges of the mixed id; k is -1 for sizes of documents, -2 for what doesn't travel."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []

        def put(k, d, low, c):
            q = ((d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            order = np.lexsort((d, q))
            q, d, c = q[order], d[order], c[order].astype(np.uint32)
            at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]).tolist() if len(q) else []
            for i, j in zip(at, [*at[1:], len(q)], strict=True) if at else ():
                rows.append((int(q[i]), k, _ids(d[i:j]), None if low is None else low[order][i:j].tobytes(), _planes(c[i:j])))

        d = np.concatenate([np.cumsum(_numbers(x.as_py(), np.int64)) for x in table.column("ids")])
        low = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("low")])
        order = np.argsort(low, kind="stable")
        low, d = low[order], d[order]
        if table.column("part")[0].as_py():
            c = np.full(len(low), HOT)
        else:
            new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.empty(0, np.int64)
            size = np.diff(np.r_[new, len(low)])
            c = np.minimum(np.repeat(size, size), HOT - 1)
        put(table.column("k")[0].as_py(), d[c > 1], low[c > 1], c[c > 1])
        for x in table.column("docs"):
            if x.is_valid:
                ids, n, skipped = np.frombuffer(x.as_py(), np.int64).reshape(3, -1)
                put(-1, ids, None, n)
                put(-2, ids, None, skipped)
        q, k, ids, low, c = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.table({"q": pa.array(q, pa.int32()), "k": pa.array(k, pa.int32()), "ids": pa.array(ids, pa.binary()), "low": pa.array(low, pa.binary()), "c": pa.array(c, pa.binary())})

    return run


def _prefixes(similarity: float):
    """applyInArrow for one range of ids: (h, d, n, pos) of the common ones among a document's first n - ceil(similarity * n) + 1 shingles, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        sized: dict = {-1: [], -2: []}
        d, h, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, ids, low, counts in zip(*(table.column(x).to_pylist() for x in ("k", "ids", "low", "c")), strict=True):
            ids, counts = np.cumsum(_numbers(ids, np.int64)), _numbers(counts, np.uint32).astype(np.int64)
            if k < 0:
                sized[k].append((ids, counts))
            else:
                d.append(ids)
                h.append(np.frombuffer(low, np.uint32).astype(np.int64) | k << 32)
                c.append(counts)
        d, h, c = map(np.concatenate, (d, h, c))
        docs, sizes, skipped = *map(np.concatenate, zip(*sized[-1], strict=True)), np.concatenate([x for _, x in sized[-2]])
        order = np.argsort(docs, kind="stable")
        docs, sizes = docs[order], sizes[order]
        ids = np.concatenate([x for x, _ in sized[-2]])
        skipped = skipped[np.argsort(ids, kind="stable")]
        last = np.r_[docs[1:] != docs[:-1], True]  # of equal rows, one
        docs, sizes, skipped = docs[last], sizes[last], skipped[last]
        order = np.lexsort((h, c, d))
        d, h = d[order], h[order]
        once = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)]
        d, h = d[once], h[once]
        of = np.searchsorted(docs, d)
        many = np.bincount(of, minlength=len(docs))
        n = sizes[of]
        pos = n - skipped[of] - many[of] + np.arange(len(d)) - (np.cumsum(many) - many)[of] + 1  # shingles of no other document come first
        kept = pos <= n - _needed(n, similarity) + 1
        return pa.table({"h": h[kept], "d": d[kept], "n": n[kept], "pos": pos[kept]})

    return run


def _hot_shingles(base: DataFrame, known: WordHashes) -> np.ndarray:
    """Shingles of over one in HOT_SHARE of the sampled documents: at most HOT_SHARE times the shingles of a document, however large the table is."""

    def run(batches):
        for got in batches:
            texts = got.column(1).cast(pa.binary())
            for start, stop in shared.runs(texts):
                h, n = np.unique(np.concatenate([shingle_set(words_of(x.as_py() or b""), known) for x in texts.slice(start, stop - start)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    sample = base.where(F.pmod(F.xxhash64("d"), F.lit(HOT_SAMPLE)) == 0)
    least = max(HOT_LEAST, sample.count() // HOT_SHARE)
    rows = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
    return np.sort(rows.toArrow().column(0).to_numpy().view(np.uint64))


def _rare(base: DataFrame, known: WordHashes, similarity: float) -> DataFrame:
    """(h, d, n, pos): the common shingles of each document's prefix. Any two sets of the similarity share one. Shingles travel packed."""
    total = base.agg(F.sum(F.length("t"))).first()[0] or 0
    ranges = RANGES
    while ranges * RANGE_SHINGLES < total // 4 and ranges < 1 << 24:
        ranges *= 2
    bits = ranges.bit_length() - 1
    packed = base.mapInArrow(_spread_shingles(known, _hot_shingles(base, known), bits, similarity), "k int, part int, ids binary, low binary, docs binary")
    common = packed.groupBy("k", "part").applyInArrow(_common_shingles(ranges // 4), "q int, k int, ids binary, low binary, c binary")
    return common.groupBy("q").applyInArrow(_prefixes(similarity), "h long, d long, n long, pos long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for the documents that have a near copy: root is the smallest node of the component. Ids are taken as given: each must stand for one text."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    known = WordHashes()

    def sketched(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(words_of(t.as_py() or b"")) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(words_of(t.as_py() or b""), known).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common / (len(x) + len(y) - common))
        return pa.array(out, pa.float64())

    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sketches = base.select("d", F.posexplode(F.arrow_udf(shared.by_runs(sketched), "array<long>")("t")).alias("k", "fp"))
    sketches = shared.stored(spark, sketches, "sketches")
    merged = shared.stored(spark, sketches.groupBy("k", "fp").agg(F.min("d").alias("d")), "merged")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(BITS)))
    spread = merged.select("d", "k", "fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).bitwiseOR(F.shiftleft(F.col("k").cast("long"), BITS)).alias("v"), "d")
    equal = sketches.join(merged.withColumnRenamed("d", "a"), ["k", "fp"]).where("a != d").select("a", F.col("d").alias("b"), F.lit(BITS + 1).cast("long").alias("c"))  # equal sketches share all variants
    with shared.arrow_rows(spark, 50_000):
        met = spread.repartition("v").sortWithinPartitions("v", "d").mapInArrow(_first_and_member, "a long, b long, c long")
        met = met.union(equal).groupBy("a", "b").agg(F.sum("c").alias("c"))
        best = shared.stored(spark, met.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"), "best")
    for done in (sketches, merged):
        shared.discard(spark, done)

    def verified(candidates: DataFrame) -> DataFrame:
        """Stored (a, b) of the candidates that are similar. A document that very many go with is one row of sets, so AQE splits its candidates."""
        ids = shared.stored(spark, candidates.select(F.col("a").alias("d")).union(candidates.select("b")).distinct(), "ids")
        sets = shared.stored(spark, shared.by_ids(base, ids, "left_semi", "d").select("d", F.arrow_udf(shared.by_runs(hashed), "binary")("t").alias("s")).dropDuplicates(["d"]), "sets")
        left = candidates.join(sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(sets.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
        out = shared.stored(spark, both.where(F.arrow_udf(jaccard, "double")("sa", "sb") >= similarity).select("a", "b"), "verified")
        for done in (ids, sets, candidates):
            shared.discard(spark, done)
        return out

    roots = shared.components(spark, verified(best))
    rare = shared.stored(spark, _rare(base, known, similarity), "rare")
    roots = count_tree.connected(spark, base, rare, roots, hashed, similarity)
    shared.discard(spark, rare)
    return roots


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    again = shared.stored(spark, again, "again")
    if again.isEmpty():
        lost = near_components(docs, similarity=similarity).where("node != root").select(F.col("node").alias("doc_id"))
        return shared.by_ids(docs, shared.stored(spark, lost, "lost"), "left_anti")
    # texts of a repeated id are told apart: every row gets a node of id and text
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", text)).alias("node")
    roots = near_components(docs.select(node, "text"), "node", similarity=similarity)
    members = shared.by_ids_join(docs.where("doc_id is not null").select("doc_id", node), roots, "node").distinct()
    least = members.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.node")
    lost = shared.stored(spark, members.select("node").join(least, "node", "left_anti").select(F.col("node").alias("_node")), "lost")
    return shared.by_ids(docs.select("*", node.alias("_node")), lost, "left_anti", "_node").drop("_node").select(*docs.columns)
