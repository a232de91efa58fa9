"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 bits differ in at most 2 bits once the
right one of three bit groups is left out. In those remaining bits both emit all
variants within half of 2, one bit, so they meet at a common variant: 132 variants
a fingerprint instead of the 2,081 that full 64-bit balls for an odd radius need.
Variants are shuffled, colliding fingerprints deduplicated and verified on all 64 bits.

Equal fingerprints are merged first, so buckets hold distinct ones. A bucket of
more than ``limit`` members isn't paired: its members go through full balls (radius
1 meets radius 2), where everything that meets is within 3 bits of a centre
member and is linked to it in a star; that is exact and linear.

Defined results: null text is empty text; no words gives fingerprint zero; rows
with a null id get a fingerprint and the component of their fingerprint; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import shared

RADIUS = 3
SEED = 42
#: Members of a bucket up to which it is verified pair by pair.
BUCKET_LIMIT = 256
GROUPS = [(0, 22), (22, 43), (43, 64)]


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return data.lower().split()


def shingles_of(words: list[bytes], width: int):
    """Space-joined runs of width words; all words where there are fewer; nothing for no words."""
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def majority(features, count: int, seeds=(SEED,)) -> np.ndarray:
    """One 64-bit SimHash for each seed over count byte strings."""
    out = np.zeros(len(seeds), dtype="<u8")
    if not count:
        return out
    features = list(features)
    for k, seed in enumerate(seeds):
        bits = np.zeros(64, dtype=np.int64)
        for at in range(0, count, 1 << 15):
            part = features[at : at + (1 << 15)]
            h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), dtype="<u8", count=len(part))
            bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits((2 * bits > count).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for every row: SimHash over word shingles, repeats counted."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), dtype=np.int64)
        for i, data in enumerate(texts.cast(pa.binary())):
            words = words_of(data.as_py() or b"")
            n = max(len(words) - width + 1, 1) if words else 0
            out[i] = majority(shingles_of(words, width), n).view(np.int64)[0]
        return pa.array(out)

    shared.bound_batches(docs.sparkSession)
    udf = F.arrow_udf(run, "long")
    return docs.select(F.col(id_col).alias("id"), udf(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[tuple[int, int]]:
    full, out = (1 << 64) - 1, []
    for low, high in GROUPS:
        keep = full & ~(((1 << high) - 1) ^ ((1 << low) - 1))
        out += [(keep, 0)] + [(keep, 1 << b) for b in range(64) if not low <= b < high]
    return [(_signed(k), _signed(f)) for k, f in out]


def _variants(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    table = F.array(*(F.struct(F.lit(k).cast("long").alias("keep"), F.lit(f).cast("long").alias("flip")) for k, f in masks))
    both = fps.select("fp", F.explode(table).alias("m"))
    return both.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("v"), "fp")


def _stars(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one bucket, reduced to a spanning star of each of its components."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(fp)))
    return fp[member], fp[label[member]]


def _bucket_links(limit: int, radius: int):
    """mapInArrow over rows sorted by variant: (a, b) links; (a, a) for members of too large buckets."""

    def links(v: np.ndarray, f: np.ndarray):
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        size = np.diff(np.r_[start, len(v)])
        two = start[size == 2]
        x, y = f[two], f[two + 1]
        ok = np.bitwise_count(x ^ y) <= radius
        a, b = [x[ok]], [y[ok]]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            part = f[s : s + n]
            p, q = (part, part) if n > limit else _stars(part, radius)
            a.append(p)
            b.append(q)
        return np.concatenate(a), np.concatenate(b)

    def batch(a: np.ndarray, b: np.ndarray):
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["a", "b"])

    def run(batches):
        v, f, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for got in batches:
            nv = got.column(0).to_numpy(zero_copy_only=False)
            nf = got.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:  # the rest of a bucket that is known to be too large
                n = int(np.searchsorted(nv, over, "right"))
                if n:
                    yield batch(nf[:n], nf[:n])
                if n == len(nv):
                    continue
                nv, nf, over = nv[n:], nf[n:], None
            v, f = np.r_[v, nv], np.r_[f, nf]
            cut = int(np.searchsorted(v, v[-1], "left"))
            if cut:
                a, b = links(v[:cut], f[:cut])
                if len(a):
                    yield batch(a, b)
            v, f = v[cut:], f[cut:]
            if len(v) > limit:
                yield batch(f, f)
                over, v, f = v[0], v[:0], f[:0]
        if len(v):
            a, b = links(v, f)
            if len(a):
                yield batch(a, b)

    return run


def _full_balls(dense: DataFrame) -> DataFrame:
    """Links among dense fingerprints: each 1-ball member is within 3 bits of each 2-ball member it meets."""
    one = [(-1, 0)] + [(-1, _signed(1 << i)) for i in range(64)]
    two = [(-1, _signed(1 << i | 1 << j)) for i in range(64) for j in range(i)]
    rows = _variants(dense, one).withColumn("far", F.lit(0)).unionByName(_variants(dense, two).withColumn("far", F.lit(1)))
    first = W.partitionBy("v").orderBy("far", "fp").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("b", F.first("fp").over(first)).withColumn("start", F.first("far").over(first))
    return rows.where((F.col("start") == 0) & (F.col("fp") != F.col("b"))).select(F.col("fp").alias("a"), "b").distinct()


def links(spark: SparkSession, distinct_fps: DataFrame, limit: int = BUCKET_LIMIT, radius: int = RADIUS) -> DataFrame:
    """Stored (a, b) links that connect exactly what links of radius or fewer bits connect."""
    spread = _variants(distinct_fps, _masks()).repartition("v").sortWithinPartitions("v", "fp")
    with shared.arrow_rows(spark, 50_000):
        found = shared.stored(spark, spread.mapInArrow(_bucket_links(limit, radius), "a long, b long").distinct(), "links")
    dense = found.where(F.col("a") == F.col("b")).select(F.col("a").alias("fp"))
    if dense.isEmpty():
        return found
    return found.where(F.col("a") != F.col("b")).union(shared.stored(spark, _full_balls(dense), "balls"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    spark = docs.sparkSession
    fps = shared.stored(spark, fingerprints(docs, id_col, text_col, width), "fingerprints")
    firsts = shared.stored(spark, fps.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    linked = links(spark, firsts.select("fp"), limit)
    roots = shared.components(spark, linked)
    shared.discard(spark, linked)
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = shared.stored(spark, grouped.join(least, "root").select("fp", "component_id"), "named")
    for done in (firsts, roots):
        shared.discard(spark, done)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
