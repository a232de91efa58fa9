"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size: class L holds items of L/2 to L shingles (at least 4). Documents
are cut into blocks of L shingles, and two neighbouring blocks make a window, which holds every passage of
L shingles whole. Containment of 0.8 in a window of known size bounds the Jaccard similarity from below (0.19), and
with HASHES one-row bands such a window misses all minima with a probability under 5e-5 (0.2 % for the
smallest items). A window's minima come from its blocks' minima, so each shingle is hashed once
for all size classes. Every candidate is verified by exact containment of the item's shingles.

Items are a query set: they are taken in blocks of ITEM_BLOCK, each block one pass over the documents.
Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters; shingles have five words, for shorter
items all their words. Defined results: items without a word match nothing, null texts are
empty; an item with a null id is searched like any other and reported with that id; equal item rows are one item, other
texts of a repeated item id are items of their own; repeated documents give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shared
from .license_join import words_of

WIDTH = 5
THRESHOLD = 0.8
HASHES = 48
SMALLEST = 4
ITEM_BLOCK = 20_000
#: Shingles of documents that are searched together.
CHUNK = 1 << 19
LOW = 0xFFFF

MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, WIDTH + 1)], dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += h[i : i + n] * POWERS[i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _minima(x: np.ndarray) -> np.ndarray:
    """(blocks of SMALLEST, HASHES) minima; x has a multiple of SMALLEST."""
    x = x.reshape(-1, SMALLEST)
    out = np.empty((len(x), HASHES), np.uint32)
    for i, a in enumerate(MULTIPLIERS):
        out[:, i] = ((x * a) >> np.uint64(32)).astype(np.uint32).min(axis=1)
    return out


class Items:
    """A block of benchmark items, by shingle width and size class."""

    def __init__(self, rows: list[tuple]):
        known, self.shingles, self.parts = WordHashes(), {}, {}
        for k, (item_id, text) in enumerate(rows):
            words = words_of((text or "").encode())
            if not words:
                continue
            width = min(WIDTH, len(words))
            own = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
            self.shingles[k] = (item_id, width, own)
            size = SMALLEST
            while size < len(words) - width + 1:
                size *= 2
            h = shingle_hashes(words, width, known)
            low = ((h[:, None] * MULTIPLIERS) >> np.uint64(32)).astype(np.uint32).min(axis=0)
            part = self.parts.setdefault(width, {}).setdefault(size, (np.zeros((HASHES, LOW + 1), bool), {}))
            for i, value in enumerate(low.tolist()):
                part[0][i, value & LOW] = True
                part[1].setdefault((i, value), []).append(k)

    def search(self, texts: list[bytes], threshold: float) -> list[list[tuple]]:
        """For each text, (item_id, item's shingles, containment) of the items that it contains."""
        found: list[list[tuple]] = [[] for _ in texts]
        known, group, size = WordHashes(), [], 0
        for i, data in enumerate(texts):
            words = words_of(data)
            group.append((i, words))
            size += len(words)
            if size >= CHUNK:
                self._search(group, threshold, found, known)
                group, size = [], 0
        self._search(group, threshold, found, known)
        return found

    def _search(self, group, threshold, found, known) -> None:
        wanted: dict[int, set] = {}
        for width, parts in self.parts.items():
            flat, begin = [], [0]
            for _, words in group:
                h = shingle_hashes(words, width, known)
                if len(h):
                    h = np.r_[h, np.repeat(h[-1:], -len(h) % SMALLEST)]
                flat.append(h)
                begin.append(begin[-1] + len(h))
            x = np.concatenate([*flat, np.empty(0, np.uint64)])
            if not len(x):
                continue
            start, block, size = np.array(begin), _minima(x), SMALLEST
            for target in sorted(parts):
                while size < target:
                    if len(block) % 2:
                        block = np.r_[block, block[-1:]]
                    block = np.minimum(block[0::2], block[1::2])
                    size *= 2
                window = np.minimum(block, np.r_[block[1:], block[-1:]])
                table, exact = parts[target]
                for w, i in zip(*np.nonzero(table[np.arange(HASHES), window & LOW]), strict=True):
                    if items := exact.get((int(i), int(window[w, i]))):
                        first = int(np.searchsorted(start, w * size, "right")) - 1
                        last = int(np.searchsorted(start, min((w + 2) * size, len(x)) - 1, "right")) - 1
                        for d in range(max(0, first), min(last, len(group) - 1) + 1):
                            wanted.setdefault(d, set()).update(items)
        for d, items in wanted.items():
            i, words = group[d]
            sets: dict[int, set] = {}
            for k in sorted(items):
                item_id, width, own = self.shingles[k]
                if width not in sets:
                    sets[width] = {b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)}
                share = len(own & sets[width]) / len(own)
                if share >= threshold:
                    found[i].append((item_id, len(own), share))


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    picked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()  # equal ones would all fall into one block
    blocks = max(1, -(-picked.count() // ITEM_BLOCK))
    for b in range(blocks):
        rows = picked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Items(sorted(((r[0], r[1]) for r in rows), key=str))


def _udf(items: Items, threshold: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())]))

    def run(texts: pa.Array) -> pa.Array:
        found = items.search([t.as_py() or b"" for t in texts.cast(pa.binary())], threshold)
        return pa.array([[{"item_id": a, "n_shingles": n, "containment": c} for a, n, c in row] for row in found], kind)

    return F.arrow_udf(shared.by_runs(run), "array<struct<item_id:long,n_shingles:long,containment:double>>")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, containment) of every item that a document contains."""
    shared.bound_batches(docs.sparkSession)
    out = None
    for block in _item_blocks(items, "item_id", "text"):
        hit = docs.select(F.col(id_col).alias("doc_id"), F.explode(_udf(block, threshold)(F.coalesce(F.col(text_col), F.lit("")))).alias("h")).select("doc_id", "h.*")
        out = hit if out is None else out.unionByName(hit)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain an item; a filter where the rows are read, with no shuffle."""
    shared.bound_batches(docs.sparkSession)
    for block in _item_blocks(items, "item_id", "text"):
        docs = docs.where(F.size(_udf(block, threshold)(F.coalesce(F.col(text_col), F.lit("")))) == 0)
    return docs
