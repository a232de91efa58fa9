"""Language by multilingual mixture inference.

Each language has a smoothed distribution over hashed letter trigrams of words (with word ends), learned from
at most PER_LANGUAGE rows of each language, by hash order (a documented bound; languages are few). A word's likelihood under a language is that of its
trigrams. For each whole text, expectation-maximisation estimates the languages' proportions; languages leave the
set, smallest proportion first, while the penalised likelihood gains. The largest proportion names the text.

Defined results: null text or text without a letter is ``und`` with score 0; without any
learned language every text is ``und``; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import shared

PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SMOOTHING = 0.5
MODULUS, HELD = 4, 2
#: Penalty of one more language, in units of log(words).
PENALTY = 2.0
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals such as fractions, which words_in takes out


def words_in(text: str) -> Counter:
    """Runs of Unicode letters, lower-cased, with their counts."""
    words = Counter(WORD.findall(text.lower()))
    for word in [w for w in words if not w.isalpha()]:
        n = words.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            words[part] += n
    return words


def grams(word: str) -> list[int]:
    marked = f"^{word}$"
    return [zlib.crc32(marked[i : i + 3].encode()) % BUCKETS for i in range(max(1, len(marked) - 2))]


def train(spark, docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Languages in order, and log probabilities (buckets x languages)."""
    base = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (shared.remainder("doc_id", MODULUS) != HELD))
    sizes = base.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row a language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thinned = base.join(F.broadcast(sizes), "lang").where(share < (1.25 * per_language + 200) / F.col("n"))  # bounds what meets in a language's window
    order = W.partitionBy("lang").orderBy(share, "doc_id", F.xxhash64("text"))
    texts = thinned.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)

    def counted(batches):
        for b in batches:
            seen: dict = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for word, n in words_in(text).items():
                    for g in grams(word):
                        own[g] += n
            for lang, own in seen.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "g", "n"])

    rows = texts.select("lang", "text").mapInArrow(counted, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return {"langs": [], "logs": np.zeros((BUCKETS, 0), np.float32)}
    langs = sorted(rows["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    table[rows["g"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy(dtype=object))] += rows["n"].to_numpy()
    used = max(1, rows["g"].nunique())
    logs = np.log(table / (table.sum(axis=0) - SMOOTHING * (BUCKETS - used)))
    return {"langs": langs, "logs": logs.astype(np.float32)}


def _mixture(lik: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int = 12) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and their log likelihood; rows of lik are scaled to a maximum of 1."""
    pi, total = start, n.sum()
    for _ in range(steps):
        joint = lik * pi
        new = (n / joint.sum(axis=1)) @ joint / total
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(n @ np.log(lik @ pi))


def infer(logs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of the languages (zero outside the selected set) from word log likelihoods and counts."""
    count = logs.shape[1]
    lik = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))
    alive = np.arange(count)
    pi, ll = _mixture(lik, n, np.full(count, 1 / count))
    cost = PENALTY * math.log(n.sum() + 1)
    while len(alive) > 1:
        drop = int(np.argmin(pi))
        rest = np.delete(alive, drop)
        left = np.delete(pi, drop)
        left = np.full(len(rest), 1 / len(rest)) if left.sum() <= 0 else left / left.sum()
        new, new_ll = _mixture(lik[:, rest], n, left)
        if new_ll + cost < ll:
            break
        alive, pi, ll = rest, new, new_ll
    out = np.zeros(count)
    out[alive] = pi
    return out


def predict_column(spark, model: dict, text_col: str = "text"):
    """A struct column: lang, score and the proportions of the selected languages."""
    langs, logs = model["langs"], model["logs"]
    shared.bound_batches(spark)
    rows: dict = {}
    table = np.empty((0, max(1, len(langs))), dtype=np.float32)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])
    state = {"table": table}

    def one(text: str) -> dict:
        words = words_in(text)
        if not words or not langs:
            return {"lang": "und", "score": 0.0, "shares": []}
        if len(rows) + len(words) > CACHE_WORDS and rows:
            rows.clear()
        fresh = [w for w in words if w not in rows]
        if fresh:
            if len(rows) + len(fresh) > len(state["table"]):
                grown = np.empty((2 * (len(rows) + len(fresh)), len(langs)), dtype=np.float32)
                grown[: len(state["table"])] = state["table"]
                state["table"] = grown
            for w in fresh:
                state["table"][len(rows)] = logs[grams(w)].sum(axis=0)
                rows[w] = len(rows)
        at = np.fromiter((rows[w] for w in words), np.int64, len(words))
        pi = infer(state["table"][at].astype(np.float64), np.fromiter(words.values(), np.float64, len(words)))
        best = int(np.argmax(pi))
        return {"lang": langs[best], "score": float(min(1.0, pi[best])), "shares": [(langs[i], float(pi[i])) for i in np.flatnonzero(pi)]}

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py() or "") for t in texts], kind)

    return F.arrow_udf(run, "struct<lang:string,score:double,shares:map<string,double>>")(F.coalesce(F.col(text_col), F.lit("")))
