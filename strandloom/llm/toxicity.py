"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text and their beginnings of 4 to 7 letters, each counted once; all that MIN_ROWS labelled rows of the sample hold are
fitted. The logistic loss with an L1 term gets, for every sentence of the labelled sample that holds group terms, the squared change of its score when
these are swapped for others of their kind, SWAPS times. This pulls the weights of such terms together, so a neutral mention doesn't raise a score.
Group terms are a fixed list; a sample without any of them is fitted as without the term.

Training takes at most PER_CLASS labelled rows of each class (a documented bound); slope and shift are calibrated on one of FOLDS rows with weights fitted on
the others. Scoring reads every whole text. Defined results: null and empty texts get the score of a text without features; repeated rows give
repeated results, and equal texts equal scores; of a document id with both labels the greater counts; without labels of both classes every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

PER_CLASS = 4000
MIN_ROWS = 4
L1 = 2e-4
COUNTERFACTUAL = 1.0
SWAPS = 3
FOLDS = 5
MODULUS, HELD = 3, 1

#: Neutral terms that name groups; terms of one line are swapped for each other.
IDENTITY_TERMS = [
    ["women", "men", "woman", "man", "girls", "boys", "transgender", "nonbinary", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "indigenous", "immigrant", "immigrants", "refugee", "refugees"],
    ["deaf", "blind", "disabled", "autistic", "elderly", "young", "old"],
]
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def kinds_of(lines: list[list[str]]) -> dict[str, list[str]]:
    """For each group term, the others of its kind."""
    return {w: [x for x in line if x != w] for line in lines for w in line if len(line) > 1}


def features_of_word(word: str, terms) -> list[str]:
    """The word itself and its beginnings, marked so as not to equal whole words; group terms have no beginnings."""
    if word in terms:
        return [word]
    return [word, *("^" + word[:n] for n in range(4, min(7, len(word)) + 1))]


def features(text: str, terms) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of_word(w, terms)}


def swaps(text: str, kinds: dict[str, list[str]]):
    """(terms that go, terms that come) for each sentence with group terms, SWAPS times; partners by a hash of sentence and turn."""
    for sentence in SENTENCE.split(text.lower()):
        own = sorted(kinds.keys() & set(WORD.findall(sentence)))
        for turn in range(SWAPS if own else 0):
            partners = {kinds[w][zlib.crc32(f"{turn} {w} {sentence}".encode()) % len(kinds[w])] for w in own}
            yield sorted(set(own) - partners), sorted(partners - set(own))


def _fit(rows: list[np.ndarray], y: np.ndarray, changes: list[tuple[list[int], list[int], int]], n: int, strength: float = COUNTERFACTUAL, steps: int = 400) -> np.ndarray:
    """Weights (the last is the intercept) by accelerated proximal gradient steps with L1; changes are (features that go, that come, times)."""
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for go, come, _ in changes for i in (*go, *come)], dtype=np.int64)
    sign = np.array([s for go, come, _ in changes for s in (-1.0,) * len(go) + (1.0,) * len(come)])
    change = np.repeat(np.arange(len(changes)), [len(go) + len(come) for go, come, _ in changes]).astype(np.int64)
    times = np.array([c for *_, c in changes], dtype=float)
    times *= 2 * strength / max(1.0, times.sum())
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))

    def pulled(w):
        """Gradient of the counterfactual term."""
        d = np.bincount(change, sign * w[at], len(changes)) * times
        return np.bincount(at, sign * d[change], n + 1)

    def gradient(w):
        z = np.bincount(owner, w[flat], len(rows)) + w[n]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(flat, r[owner], n + 1)
        g[n] = r.sum()
        return g + pulled(w) if len(at) else g

    v, bound = np.random.default_rng(3).normal(size=n + 1), 1.0  # the largest curvature of both terms, by power steps
    for _ in range(50):
        z = np.bincount(owner, v[flat], len(rows)) + v[n]
        u = np.bincount(flat, (weight * z / 4)[owner], n + 1)
        u[n] = (weight * z / 4).sum()
        if len(at):
            u = u + pulled(v)
        bound = np.linalg.norm(u)
        v = u / max(bound, 1e-12)
    step = 1 / (1.2 * max(bound, 1e-12))
    w = prev = np.zeros(n + 1)
    t = 1.0
    for _ in range(steps):
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / t2 * (w - prev)
        new = ahead - step * gradient(ahead)
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - step * L1, 0)
        prev, w, t = w, new, t2
    return w


def train(spark, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, strength: float = COUNTERFACTUAL) -> dict | None:
    """Weights by feature, and the intercept; None without labels of both classes."""
    sample = shared.stored(spark, shared.labelled_sample(spark, docs, labels, "toxic", MODULUS, HELD, per_class), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    shared.bound_batches(spark)
    kinds = kinds_of(IDENTITY_TERMS)

    def counted(batches):
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                seen.update(features(text, kinds))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    table = sample.select("text").mapInArrow(counted, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_ROWS) | F.col("f").isin(sorted(kinds)))
    index = {f: i for i, f in enumerate(table.select("f").orderBy("f").toArrow().column(0).to_pylist())}  # bounded with the sample

    def encoded(batches):
        for b in batches:
            own = [sorted({index[f] for f in features(text, kinds) if f in index}) for text in b.column(2).to_pylist()]
            rest = [zlib.crc32(f"fit {i}".encode()) % FOLDS == 0 for i in b.column(0).to_pylist()]
            order = [f"{i}" for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(rest), pa.array(order)], names=["label", "own", "rest", "id"])

    def changed(batches):
        for b in batches:
            pairs: Counter = Counter()
            for text in b.column(0).to_pylist():
                pairs.update((tuple(index[w] for w in go if w in index), tuple(index[w] for w in come if w in index)) for go, come in swaps(text, kinds))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)] + [pa.array(list(pairs.values()), pa.int64())], names=["go", "come", "n"])

    got = sample.select("doc_id", "label", "text").mapInArrow(encoded, "label int, own array<int>, rest boolean, id string").orderBy("label", "id").toArrow().combine_chunks()
    own = [np.array(r.values.to_numpy(), dtype=np.int64) if r.values is not None else np.empty(0, np.int64) for r in got.column("own")]
    y, rest = got.column("label").to_numpy().astype(float), got.column("rest").to_numpy(zero_copy_only=False)
    pairs = sample.select("text").mapInArrow(changed, "go array<bigint>, come array<bigint>, n long").groupBy("go", "come").agg(F.sum("n").alias("n")).collect()
    changes = sorted((list(r["go"]), list(r["come"]), r["n"]) for r in pairs if r["go"] or r["come"])
    shared.discard(spark, sample)

    def fit(places):
        return _fit([own[i] for i in places], y[places], changes, len(index), strength)

    w = fit(np.arange(len(y)))
    most, held = np.flatnonzero(~rest), np.flatnonzero(rest)
    if min(len(set(y[most])), len(set(y[held]))) < 2:  # too few rows to keep any from a fit
        held, v = np.arange(len(y)), w
    else:
        v = fit(most)
    z, y = np.array([v[own[i]].sum() for i in held]) + v[-1], y[held]
    share = labels.where(F.col("toxic").isin(0, 1) & (shared.remainder("doc_id", MODULUS) != HELD)).agg(F.avg("toxic")).first()[0]
    slope, shift = _calibrated(z, y, share)
    return {"weights": {f: float(w[i]) for f, i in index.items() if w[i]}, "intercept": float(w[-1]), "slope": slope, "shift": shift, "terms": frozenset(kinds), "changes": len(changes)}


def _calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift that fit the labels, at their share among all labelled rows; ridge towards slope 2."""
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum()))
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([2.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * (w - np.array([2.0, 0.0]))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(w[0]), float(w[1])


def score_column(spark, model: dict | None, text_col: str = "text"):
    """A column: the calibrated score, 0 to 1, of the whole text."""
    if model is None:
        return F.lit(0.5)
    shared.bound_batches(spark)
    weights, terms = model["weights"], model["terms"]
    cache: dict = {}

    def hits(word: str) -> tuple:
        found = tuple(f for f in features_of_word(word, terms) if f in weights)
        if len(cache) < 500_000:
            cache[word] = found
        return found

    def logit(text: str) -> float:
        found = {f for w in set(WORD.findall(text.lower())) for f in (cache[w] if w in cache else hits(w))}
        return model["slope"] * (model["intercept"] + sum(weights[f] for f in sorted(found))) + model["shift"]

    def run(texts: pa.Array) -> pa.Array:
        z = np.array([logit(t.as_py() or "") for t in texts], dtype=float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.arrow_udf(run, "double")(F.coalesce(F.col(text_col), F.lit("")))
