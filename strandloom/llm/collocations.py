"""Collocations: phrases that occur together far more often than their parts would by chance.

Hierarchical pair naming. Texts become blocks: rows that hold the distinct grams of some megabytes of text, their counts and
the order in which they stand. Grams are counted over all blocks, the frequent ones get a global name (an id), and a join
brings the names back to the blocks, once for each distinct gram of a block instead of each occurrence. There two neighbouring
frequent (k-1)-grams make a k-gram, named by the pair of their ids. As no k-gram is more frequent than its parts, none is lost.
The pair is also a pair of parent pointers: frequencies of the two sides of every cut come down them, and a longer phrase
marks the two that it holds.

Only a longer phrase's direct parents need marks: what holds a phrase from further off has a part between
that is at least as frequent, so a candidate too, and marks it as well.

Defined results: null text is empty, null lang is ``und``; equal rows count as often as they stand; other columns are ignored; an
empty table gives an empty result. Pieces, and so texts, of any length are taken whole. Counts may reach 10^16 before a product
passes 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.operators.ranges import ranked

from . import shared

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A phrase goes where a longer one that holds it has so many of a hundred of its occurrences.
SUBSUMED = 50
#: Bytes of text that a block holds at least, unless the task has no more.
BLOCK_BYTES = 8 << 20
#: Buckets of the first of two rankings of a language.
BUCKETS = 64
CUTS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, every cut a full stop, tabs blanks: afterwards no word holds a full stop.
LOWER = bytes.maketrans(bytes(range(65, 91)) + CUTS + b"\t", bytes(range(97, 123)) + b"." * len(CUTS) + b" ")


def words_and_cuts(text: bytes) -> list[bytes]:
    """Words in order, with a full stop wherever a piece ends."""
    return [w for w in text.translate(LOWER).replace(b".", b" . ").split(b" ") if w]


def _planes(x: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, which compress well."""
    return np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


BLOCK = "block long, lang string, {grams}, counts array<int>, seq binary"
WORD_BLOCK, PAIR_BLOCK = BLOCK.format(grams="word array<string>"), BLOCK.format(grams="left array<long>, right array<long>")


def _word_blocks(batches):
    """mapInArrow over (lang, text): blocks of words; seq has the places of the words in the block's list, -1 for a cut."""
    made, held, size = TaskContext.get().partitionId() << 40, {}, 0

    def full():
        nonlocal made
        for lang, texts in held.items():
            coded = pa.concat_arrays(texts).dictionary_encode()
            words, seq = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            cut = pc.index(words, pa.scalar(b".", pa.binary())).as_py()  # every text ends with one
            seq = np.where(seq == cut, -1, seq - (seq > cut))
            words = pa.concat_arrays([words.slice(0, cut), words.slice(cut + 1)]).cast(pa.string())
            counts = np.bincount(seq[seq >= 0], minlength=len(words)).astype(np.int32)
            made += 1
            if len(words):
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int32())), pa.array([_planes(seq)], pa.binary())], names=["block", "lang", "word", "counts", "seq"])
        held.clear()

    for got in batches:
        for lang, text in zip(got.column(0).to_pylist(), got.column(1).cast(pa.binary()), strict=True):
            data = text.as_py() or b""
            held.setdefault(lang, []).append(pa.array([*words_and_cuts(data), b"."], pa.binary()))  # one text's words at a time are Python objects
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from full()
                size = 0
    yield from full()


def _pair_blocks(batches):
    """mapInArrow over (block, lang, seq, i, id): blocks of the pairs of neighbouring grams that have names; seq keeps a -1 where neighbours are not at neighbouring places."""
    for got in batches:
        for block, lang, seq, at, ids in zip(*(got.column(k) for k in range(5)), strict=True):
            seq = _from_planes(seq.as_py()).astype(np.int64)
            width = int(seq.max()) + 1
            names = np.zeros(width + 1, np.int64)  # the last is for -1
            names[at.values.to_numpy()] = ids.values.to_numpy()
            known = names[seq] > 0
            both = np.flatnonzero(known[:-1] & known[1:])
            if not len(both):
                continue
            pairs, of, counts = np.unique(seq[both] * width + seq[both + 1], return_inverse=True, return_counts=True)
            gaps = np.flatnonzero(np.diff(both) > 1) + 1
            out = np.insert(of, gaps, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.as_py()]), pa.array([lang.as_py()], pa.string()), *(pa.array([names[x]], pa.list_(pa.int64())) for x in (pairs // width, pairs % width)), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([_planes(out)], pa.binary())],
                names=["block", "lang", "left", "right", "counts", "seq"],
            )


def _grams(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(block, i, keys, c): a row for each distinct gram of a block."""
    of = [k for k in keys if k != "lang"]
    rows = blocks.select("block", "lang", F.posexplode(F.arrays_zip(*of, "counts")).alias("i", "g"))
    return rows.select("block", "i", *(F.col("lang") if k == "lang" else F.col(f"g.{k}").alias(k) for k in keys), F.col("g.counts").alias("c"))


def _named(blocks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Stored (id, keys, f) of the grams that are frequent over all blocks."""
    spark = blocks.sparkSession
    counted = shared.stored(spark, _grams(blocks, keys).groupBy(*keys).agg(F.sum(F.col("c").cast("long")).alias("f")).where(F.col("f") >= least), "frequent")
    out = shared.stored(spark, ranked(counted, [F.col(k) for k in keys], "id").select("id", *keys, "f"), "names")  # ids without gaps are short, and are shuffled often
    shared.discard(spark, counted)
    return out


def _next_blocks(blocks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Stored blocks of pairs: each block gets the names of its own grams."""
    met = _grams(blocks, keys).drop("c").join(names.select("id", *keys), keys).select("block", "i", "id")
    own = met.groupBy("block").agg(F.collect_list(F.struct("i", "id")).alias("n"))
    both = blocks.select("block", "lang", "seq").join(own, "block").select("block", "lang", "seq", F.col("n.i").alias("i"), F.col("n.id").alias("id"))
    return shared.stored(blocks.sparkSession, both.mapInArrow(_pair_blocks, PAIR_BLOCK), "pair-blocks", wide=True)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    wide = lambda c: c.cast("decimal(16,0)")
    up = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def named_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """Stored (id, lang, phrase, f, pre, suf, last, held) of the frequent phrases of 1 to max_words words, one table a length, and (lang, n).

    pre and suf have the frequencies of the first and the last 1, 2, ... words, up to the phrase's length less one; held is the largest frequency of a phrase longer by one word that holds it.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = shared.stored(spark, texts.mapInArrow(_word_blocks, WORD_BLOCK), "word-blocks", wide=True)
    totals = shared.stored(spark, blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    keys = ["lang", "word"]
    names = _named(blocks, keys, least)
    none = F.array().cast("array<long>")
    levels = [shared.stored(spark, names.select("id", "lang", F.col("word").alias("phrase"), "f", none.alias("pre"), none.alias("suf"), F.col("word").alias("last")), "phrases")]
    for _ in range(1, max_words):
        nxt = _next_blocks(blocks, names, keys)
        for done in (blocks, names):
            shared.discard(spark, done)
        keys = ["left", "right"]
        blocks, below = nxt, levels[-1]
        names = _named(blocks, keys, least)
        first = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.array_append("pre", F.col("f")).alias("pre"))
        rest = below.select(F.col("id").alias("right"), "last", F.array_append("suf", F.col("f")).alias("suf"))
        here = names.join(first, "left").join(rest, "right")
        held = names.select(F.col("left").alias("id"), "f").union(names.select("right", "f")).groupBy("id").agg(F.max("f").alias("held"))
        marked = shared.stored(spark, below.join(held, "id", "left"), "marked")
        here = shared.stored(spark, here.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", "pre", "suf", "last"), "phrases")
        shared.discard(spark, below)
        levels[-1:] = [marked, here]
    for done in (blocks, names):
        shared.discard(spark, done)
    levels[-1] = levels[-1].withColumn("held", F.lit(None).cast("long"))
    return levels, totals


def best_cut(pre: Column, suf: Column, f: Column, words: int) -> Column:
    """Struct (score, k, l, r) of the cut with the lowest score, of equal ones the first."""
    cuts = [F.struct(score(f, F.element_at(pre, k), F.element_at(suf, words - k)).alias("score"), F.lit(k).alias("k"), F.element_at(pre, k).alias("l"), F.element_at(suf, words - k).alias("r")) for k in range(1, words)]
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to max_words words."""
    levels, totals = named_phrases(docs, lang_col, text_col, max_words, least)
    rows = None
    for words, level in enumerate(levels[1:], 2):
        kept = level.where(F.col("held").isNull() | (100 * F.col("held") < SUBSUMED * F.col("f")))
        part = kept.select("lang", "phrase", F.col("f").alias("a"), best_cut(F.col("pre"), F.col("suf"), F.col("f"), words).alias("cut"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's best in each bucket first, so that its last ranking has no more than BUCKETS * top rows
    some = rows.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP) -> str:
    """The same as DuckDB SQL, over every occurrence."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sizes = range(1, max_words + 1)
    ahead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY piece ORDER BY pos) AS w{k}" for k in range(1, max_words))
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, concat_ws(' ', {', '.join(['w', *(f'w{j}' for j in range(1, k))])}) AS phrase FROM o" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in sizes)
    parts = " UNION ALL ".join(f"SELECT lang, phrase, f AS a, {c} AS c, array_to_string(w[1:{c}], ' ') AS p1, array_to_string(w[{c + 1}:], ' ') AS p2 FROM cand WHERE k = {k}" for k in sizes if k > 1 for c in range(1, k))
    inner = " UNION ALL ".join(f"SELECT lang, f, array_to_string(w[{i} : {i + j - 1}], ' ') AS phrase FROM cand WHERE k = {k}" for k in sizes for j in range(2, k) for i in range(1, k - j + 2))
    return (
        f"WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
        "q AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM t), p AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM q), "
        f"o AS (SELECT *, {ahead} FROM p), "
        f"g AS ({grams}), f AS (SELECT lang, k, phrase, lang || ' ' || phrase AS key, count(*) AS f FROM g GROUP BY ALL), tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang), "
        f"cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {least}), cuts AS ({parts}), "
        "sc AS (SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts JOIN f x ON x.key = cuts.lang || ' ' || p1 JOIN f y ON y.key = cuts.lang || ' ' || p2), "
        "best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1), "
        f"held AS (SELECT lang, phrase, max(f) AS h FROM ({inner}) GROUP BY ALL), "
        f"kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE h IS NULL OR 100 * h < {SUBSUMED} * a) "
        f"SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN tot USING (lang) QUALIFY rank <= {top}"
    )


ORACLE = oracle()
