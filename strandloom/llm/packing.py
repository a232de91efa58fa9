"""Best-fit packing with patterns fitted by non-negative least squares.

A document's ids and an end id are cut into pieces of at most LIMIT tokens only where they are longer. Only the histogram
of piece lengths, at most LIMIT counts, reaches the driver. There, patterns of up to four coarse lengths that
fill a sequence are fitted to the histogram by non-negative least squares and rounded down; their slots take
exact lengths from the histogram, the last slot the longest that fits, and what is left, and the room left in patterns, is packed best-fit, longest
first. All of this works on lengths with repeat counts, so its size is bounded by LIMIT, not by the corpus.
Pieces of one length are interchangeable: each gets a rank among its length, counted in salted groups so that a
very common length doesn't meet in one task, and the plan maps ranks to sequences.

Defined results: null and empty texts are one piece, the end id; repeated rows are packed each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import shared

LIMIT = 4096
END_ID = 1
#: Coarse lengths a pattern is made of.
GRAIN = 128
KNOWN_WORDS = 700_000
#: Texts whose fresh words are tokenised together.
TOGETHER = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of Latin letters and ASCII only: composed already, and cut below as the tokenizer cuts them.
PLAIN = re.compile("[\\x20-\\x7e\\n\\r\\tÀ-ÖØ-öø-ÿ]*")
WORD = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


# How the vocabulary file for which WORD holds normalises and cuts texts.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_by_words(rules: dict) -> bool:
    """Whether a tokenizer file's rules are those for which a plain text's ids are the ids of its words in turn, each with a mark at its end."""
    model, special = rules["model"], [t["content"] for t in rules.get("added_tokens") or []]
    return (
        (rules.get("normalizer") or {}).get("normalizers") == NORMALISERS
        and ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0] == CUT
        and [x["type"] for x in rules["pre_tokenizer"]["pretokenizers"][1:]] == ["ByteLevel"]
        and rules["pre_tokenizer"]["pretokenizers"][1].get("use_regex") is False
        and rules["pre_tokenizer"]["pretokenizers"][1].get("add_prefix_space") is False
        and (model.get("type"), model.get("end_of_word_suffix"), bool(model.get("dropout"))) == ("BPE", "</w>", False)
        and all(t.startswith("<|") for t in special)
    )


class KnownIds:
    """Ids of texts as little-endian bytes, put together from those of their words.

    That holds for vocabularies whose rules pass cuts_by_words; with others, whole texts are tokenised. Such a vocabulary drops white space and merges nothing across words, so a plain text's ids are those of its words in
    turn. Words are kept while they are few; fresh ones are tokenised many to a call, and as each ends in a
    token with the end-of-word mark, the call's ids are cut there. Other texts are tokenised as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        with open(path, "rb") as f:
            self.by_words = cuts_by_words(json.load(f))

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                self.known.update(zip(part, self._each(part), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            part = texts[at : at + TOGETHER]
            words = [WORD.findall(t.lower()) if self.by_words and "<|" not in t and PLAIN.fullmatch(t) else None for t in part]
            self._learn(list(set().union(*filter(None, words)).difference(self.known)))
            known = self.known.__getitem__
            out += [self._each([t])[0] if w is None else b"".join([*map(known, w)]) for t, w in zip(part, words, strict=True)]
        return out


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, crc) for every piece of every row."""
    path = tokenizer or default_tokenizer()
    shared.bound_batches(docs.sparkSession)
    end, kept = np.array([end_id], "<u4").tobytes(), {}
    kind = pa.list_(pa.struct([("length", pa.int32()), ("crc", pa.int64()), ("start", pa.int64()), ("piece", pa.int32())]))

    def cut_up(ids: bytes) -> list[dict]:
        out, step = [], 4 * limit
        for k, at in enumerate(range(0, len(ids), step)):
            part = ids[at : at + step]
            out.append({"length": len(part) // 4, "crc": zlib.crc32(part), "start": at // 4, "piece": k})
        return out

    def run(texts: pa.Array) -> pa.Array:
        if "ids" not in kept:
            kept["ids"] = KnownIds(path)
        return pa.array([cut_up(ids + end) for ids in kept["ids"].of([t or "" for t in texts.to_pylist()])], kind)

    cut = F.arrow_udf(shared.by_runs(run), "array<struct<length:int,crc:long,start:long,piece:int>>")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut).alias("p")).select("doc_id", "p.piece", "p.start", "p.length", "p.crc")


def patterns(slots: int, most: int = 4) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` coarse lengths, 1 to slots, that sum to slots."""
    out = []

    def grow(prefix: tuple, left: int, low: int):
        if left == 0:
            out.append(prefix)
        elif len(prefix) < most:
            for x in range(low, left + 1):
                if x == left or (len(prefix) < most - 1 and left - x >= x):
                    grow((*prefix, x), left - x, x)

    grow((), slots, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient steps."""
    gram, target = a.T @ a, a.T @ b
    rate = 1 / np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (gram @ y - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repeats, [(length, count), ...])]: sequence kinds that take every piece of the histogram once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    grain = max(1, limit // (LIMIT // GRAIN))
    slots = -(-limit // grain)
    open_kinds: dict[int, list] = defaultdict(list)  # free room: [repeats, contents]
    done: list = []

    def coarse(n: int) -> int:
        return -(-n // grain)

    shapes = patterns(slots)
    a = np.zeros((slots, len(shapes)))
    for j, shape in enumerate(shapes):
        for x in shape:
            a[x - 1, j] += 1
    want = np.zeros(slots)
    for n, c in left.items():
        want[coarse(n) - 1] += c
    repeats = np.floor(nnls(a, want) + 1e-9).astype(int) if want.sum() else np.zeros(len(shapes), int)
    stock = sorted(left)  # lengths that are left

    def longest(most: int, low: int, need: dict[int, int]) -> int | None:
        """The longest length in (low, most] that is left beyond what need takes."""
        for at in range(bisect_right(stock, most) - 1, -1, -1):
            if stock[at] <= low:
                return None
            if left[stock[at]] > need.get(stock[at], 0):
                return stock[at]
        return None

    for j in np.argsort(-repeats, kind="stable"):
        shape, times = shapes[j][::-1], int(repeats[j])
        while times > 0:
            need: dict[int, int] = {}
            room = limit
            for k, x in enumerate(shape):
                last = k == len(shape) - 1 and k > 0  # the last slot takes what fits the room best
                n = longest(room if last else min(room, x * grain), max(0, (x - 1 - last) * grain), need)
                if n is None:
                    break
                need[n] = need.get(n, 0) + 1
                room -= n
            else:
                many = min(times, *(left[n] // c for n, c in need.items()))
                for n, c in need.items():
                    left[n] -= many * c
                    if not left[n]:
                        stock.remove(n)
                times -= many
                open_kinds[room].append([many, sorted(need.items(), reverse=True)])
                continue
            break
    rooms = sorted(r for r in open_kinds if open_kinds[r])

    def put(room: int, kind: list) -> None:
        if not open_kinds[room]:
            insort(rooms, room)
        open_kinds[room].append(kind)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                many, rest = divmod(count, limit // n)
                if many:
                    put(limit - limit // n * n, [many, [(n, limit // n)]])
                if rest:
                    put(limit - rest * n, [1, [(n, rest)]])
                break
            room = rooms[at]
            many, kind = open_kinds[room].pop()
            if not open_kinds[room]:
                rooms.pop(at)
            each = min(room // n, count)
            times = min(many, count // each)
            if times < many:
                put(room, [many - times, kind])
            put(room - each * n, [times, [*kind, (n, each)]])
            count -= times * each
    for room in open_kinds:
        done += [(many, kind) for many, kind in open_kinds[room] if many]
    return done


def slots_of(kinds: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, place of the first) for each length of each kind."""
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for many, kind in kinds:
        at = 0
        for n, c in kind:
            out.append((n, ranks[n], c, sequence, at))
            ranks[n] += many * c
            at += n * c
        sequence += many
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece at its place."""
    spark = docs.sparkSession
    cut = shared.stored(spark, pieces(docs, tokenizer, limit, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = slots_of(plan(histogram, limit))
    by: dict[int, list] = defaultdict(list)
    for n, first, c, sequence, at in rows:
        by[n].append((first, c, sequence, at))
    table = {n: np.array(sorted(v), dtype=np.int64) for n, v in by.items()}
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "crc"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "crc")) - 1)
    ranked = ranked.join(counts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("base") + F.col("r"))

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for length in np.unique(n):
            own, rows = n == length, table[int(length)]
            row = rows[np.searchsorted(rows[:, 0], r[own], "right") - 1]
            k = r[own] - row[:, 0]
            sequence[own], offset[own] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * length
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    put = F.arrow_udf(place, "struct<sequence_id:long,offset:long>")("length", "rank")
    return ranked.withColumn("p", put).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "p.sequence_id", "p.offset")
