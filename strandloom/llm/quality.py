"""Quality scores from compression: how much better good than bad labelled text predicts a document.

Two raw-content zstandard dictionaries, of good and of bad labelled text, compress each block of
a document. The difference of the two sizes over the document's length, with the
sizes themselves, is calibrated by a logistic model on labelled rows that no dictionary holds.

Training takes at most PER_CLASS labelled rows of each class (a documented bound), half of them for the dictionaries; scoring reads every
whole text. Defined results: null and empty texts get the score of an empty document; repeated rows give
repeated results, and equal texts equal scores; of a document id with both labels the greater counts; with one constant label, or fewer than four non-empty labelled texts of a class, every
score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import shared

PER_CLASS = 1500
DICTIONARY_BYTES = 1 << 17
BLOCK_BYTES = 2048
LEVEL = 3
PIECE_BYTES = 1024
#: Ids whose crc32 modulo MODULUS is HELD are never learned from.
MODULUS, HELD = 4, 2


def _pieces(key: str, data: bytes, count: int) -> list[bytes]:
    """count pieces of at most PIECE_BYTES, at places drawn by a generator of the key."""
    rng = np.random.default_rng(zlib.crc32(f"piece {key}".encode()))
    return [data[at : at + PIECE_BYTES] for at in (int(rng.integers(0, max(1, len(data) - PIECE_BYTES + 1))) for _ in range(count))]


def _dictionary(pieces: list[list[bytes]]) -> bytes:
    """The first piece of every text, as long as all have room, up to PIECE_BYTES; where room is left, further pieces in turn."""
    size, high = 1, PIECE_BYTES
    while size < high:
        middle = (size + high + 1) // 2
        size, high = (middle, high) if sum(min(len(p[0]), middle) for p in pieces) <= DICTIONARY_BYTES else (size, middle - 1)
    parts = [p[k][:size] for k in range(max(map(len, pieces))) for p in pieces if k < len(p)]
    kept, used = [], 0
    for part in parts:
        if used + len(part) > DICTIONARY_BYTES:
            break
        kept.append(part)
        used += len(part)
    return b"".join(kept)


class Sizer:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    @staticmethod
    def _compressor(content: bytes):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def base(self, data: bytes) -> list[float]:
        step = -(-len(data) // max(1, -(-len(data) // BLOCK_BYTES))) or 1
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        good = sum(len(self.good.compress(b)) for b in blocks) - 5 * len(blocks)
        bad = sum(len(self.bad.compress(b)) for b in blocks) - 5 * len(blocks)
        size = len(data) + 20
        return [10 * (bad - good) / size, good / size, bad / size, 10 * (bad - good) / (bad + good + 20)]


def _expanded(base: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares and products beside the sizes, which are kept to the range that calibration saw: a text that a dictionary
    holds goes to the end of that range, not to where a square would turn."""
    base = np.clip(base, low, high)
    return np.hstack([np.ones((len(base), 1)), base, base * base, base[:, :1] * base[:, 1:]])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights by Newton steps, each halved until the loss falls."""
    w = np.zeros(x.shape[1])

    def loss(v):
        return np.logaddexp(0, -(2 * y - 1) * (x @ v)).mean() + l2 / 2 * v @ v

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def _learns(doc_id) -> bool:
    """Whether a sampled row's text goes into its class's dictionary; the others calibrate."""
    return bool(zlib.crc32(f"half {doc_id}".encode()) & 1)


def train(spark, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Dictionaries from every other sampled row, calibration from the rest; None without four non-empty texts of both classes.

    Whole texts stay on the executors: the driver gets pieces for the dictionaries, bounded in number and bytes, and the calibration rows' sizes.
    """
    sample = shared.stored(spark, shared.labelled_sample(spark, docs, labels, "quality", MODULUS, HELD, per_class).where("length(text) > 0").select("doc_id", "label", "text"), "quality-sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 4:
        return None
    each = {v: 1 + 2 * DICTIONARY_BYTES // PIECE_BYTES // (c // 2) for v, c in n.items()}

    def cut_up(batches):
        for b in batches:
            rows = [(i, v, _pieces(i, t, each[v])) for i, v, t in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2).cast(pa.binary()).to_pylist(), strict=True) if _learns(i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["doc_id", "label", "pieces"])

    cut = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(cut_up, "doc_id long, label int, pieces array<binary>").collect()
    cut.sort(key=lambda r: (zlib.crc32(f"turn {r['doc_id']}".encode()), r["doc_id"], r["pieces"]))  # ids may go with time or source
    learned = {v: [list(map(bytes, r["pieces"])) for r in cut if r["label"] == v] for v in (0, 1)}
    if not learned[0] or not learned[1]:
        return None
    good, bad = _dictionary(learned[1]), _dictionary(learned[0])

    def sized(batches):
        sizer = Sizer(good, bad)
        for b in batches:
            rows = [(v, sizer.base(t)) for i, v, t in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2).cast(pa.binary()).to_pylist(), strict=True) if not _learns(i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "base"])

    rest = sorted((r["label"], list(r["base"])) for r in sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(sized, "label int, base array<double>").collect())
    shared.discard(spark, sample)
    y = np.array([v for v, _ in rest], dtype=float)
    if len(set(y)) < 2:
        return None
    base = np.array([x for _, x in rest])
    low, high = base.min(0), base.max(0)
    x = _expanded(base, low, high)
    mean, dev = x.mean(0), x.std(0)
    mean[0], dev[dev == 0] = 0, 1
    w = _logistic((x - mean) / dev, y)
    counts = labels.where(F.col("quality").isin(0, 1) & (shared.remainder("doc_id", MODULUS) != HELD)).groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in counts}
    w = w / dev
    w[0] -= mean @ w
    w[0] += math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))  # the sample is balanced, the labels aren't
    return {"good": good, "bad": bad, "w": w, "low": low, "high": high}


def score_column(spark, model: dict | None, text_col: str = "text"):
    """A column: the calibrated score, 0 to 1, of the whole text."""
    if model is None:
        return F.lit(0.5)
    shared.bound_batches(spark)
    kept: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        sizer = kept.get("sizer") or kept.setdefault("sizer", Sizer(model["good"], model["bad"]))
        base = np.array([sizer.base(x.as_py() or b"") for x in texts.cast(pa.binary())]).reshape(len(texts), -1)
        if not len(base):
            return pa.array([], pa.float64())
        return pa.array(1 / (1 + np.exp(-np.clip(_expanded(base, model["low"], model["high"]) @ model["w"], -30, 30))))

    return F.arrow_udf(run, "double")(F.coalesce(F.col(text_col), F.lit("")))
