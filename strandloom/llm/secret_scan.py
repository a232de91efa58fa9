"""Secret scans: key patterns, and sliding-window Shannon entropy. DataFrame functions only.

Base kinds are patterns, leftmost and non-overlapping. A match's place comes from splitting the text at the same
pattern and adding lengths. The entropy kinds look at candidate strings by character class, hex digits
or base64-like characters: a window of WINDOW characters slides over the string, its
sum of c * log2(c) over character counts is updated by the one count that leaves and the one that enters, and windows
at or over the class's threshold are merged into spans. An allow-list suppresses known harmless shapes.

Arrays grow by copies in Spark, so running sums and windows go in chunks of CHUNK, and what is used twice
is bound to a lambda's variable: the work is linear in a text, also for one candidate that fills it and for very many matches.

Defined results: null text is empty text and gives a row without spans; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ that have 20 or more characters
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 or more characters
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

WINDOW = 20
CHUNK = 128
#: Bits a character from which a window counts: hex strings (at most 4), and base64-like ones (at most log2(20)).
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Candidates that hold any of these are harmless: UUIDs, dates and times, placeholders, runs of one sequence.
ALLOWED = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^\d{4}-\d{2}-\d{2}|(?i:example|sample|placeholder|changeme|xxxx|012345678|abcdefgh)"
#: Code of the character before the first of a candidate's alphabet, and how many codes that spans.
BASE_CODE, CODES = 42, 80

BASE_KINDS = ["assign", "access", "hex"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def chunks(size: Column) -> Column:
    """Numbers of the chunks of an array of that size."""
    return F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))).otherwise(none("int"))


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it, by one pass that copies what it has so far."""
    zero = F.struct(F.lit(0).alias("s"), none("int").alias("out"))
    return F.aggregate(numbers, zero, lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["out"], F.array(t["s"])).alias("out")), lambda t: t["out"])


def running(numbers: Column) -> Column:
    """sums_before by chunks: within each, and over the chunks' sums."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x)
    moved = lambda part, by: bound(by, lambda b: F.transform(sums_before(part), lambda x: x + b))
    of_parts = lambda parts: F.flatten(F.zip_with(parts, sums_before(F.transform(parts, total)), moved))
    return bound(numbers, lambda a: bound(F.transform(chunks(F.size(a)), lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK))), of_parts))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all matches, in code points."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
        lengths = F.transform(found, lambda x: F.length(x))
        return bound(gaps, lambda g: F.zip_with(F.zip_with(running(F.zip_with(g, lengths, lambda a, b: a + b)), g, lambda a, b: a + b), found, lambda a, v: F.struct(a.alias("start"), v.alias("value"))))

    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none("struct<start:int,value:string>"))


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].cast("long").alias("start"), F.lit(order).alias("k"), (m["start"] + F.length(m["value"])).cast("long").alias("end"), F.lit(kind).alias("kind")))


def _logs() -> Column:
    return F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)))


def _hot_ends(codes: Column, limit: Column) -> Column:
    """Places in codes, of one chunk and the WINDOW - 1 before it, where a window ends whose sum of c * log2(c) is at most limit."""
    logs = _logs()
    zero = F.struct(F.array_repeat(F.lit(0), CODES).alias("n"), F.lit(0.0).alias("s"), none("int").alias("out"))

    def changed(s: Column, code: Column, by: int) -> Column:
        def to(n: Column) -> Column:
            counts = F.concat(F.slice(s["n"], F.lit(1), code - 1), F.array(n + by), F.slice(s["n"], code + 1, F.lit(CODES) - code))
            return F.struct(counts.alias("n"), (s["s"] + F.element_at(logs, n + by + 1) - F.element_at(logs, n + 1)).alias("s"), s["out"].alias("out"))

        return bound(F.element_at(s["n"], code), to)

    def step(s: Column, x: Column) -> Column:
        without = F.when(x["gone"] > 0, changed(s, x["gone"], -1)).otherwise(s)
        moved = bound(without, lambda t: changed(t, x["code"], 1))
        return bound(moved, lambda t: F.struct(t["n"].alias("n"), t["s"].alias("s"), F.when((x["i"] >= WINDOW - 1) & (t["s"] <= limit), F.concat(t["out"], F.array(x["i"]))).otherwise(t["out"]).alias("out")))

    moves = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("code"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(0)).alias("gone")))
    return F.aggregate(moves, zero, step, lambda s: s["out"])


def hot_windows(value: Column, bits: Column) -> Column:
    """Merged (a, b) of the windows of value whose entropy is at least bits, by incremental counts."""
    limit = (F.lit(math.log2(WINDOW)) - bits) * F.lit(float(WINDOW)) + F.lit(1e-9)  # entropy = log2(W) - sum / W
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.ascii(c) - BASE_CODE), lambda c: c > 0)

    def ends(c: Column) -> Column:
        def of_chunk(k: Column) -> Column:
            start = F.greatest(k * CHUNK - (WINDOW - 1), F.lit(0))
            return bound(F.slice(c, start + 1, (k + 1) * CHUNK - start), lambda part: F.transform(_hot_ends(part, limit), lambda i: i + start))

        return F.flatten(F.transform(chunks(F.size(c)), of_chunk))

    def merged(e: Column) -> Column:
        firsts = F.filter(e, lambda x, j: (j == 0) | (F.get(e, j - 1) < x - WINDOW))
        lasts = F.filter(e, lambda x, j: (j == F.size(e) - 1) | (F.get(e, j + 1) > x + WINDOW))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct((a - (WINDOW - 1)).alias("a"), (b + 1).alias("b")))

    return bound(bound(codes, ends), merged)


def entropy_spans(text: Column) -> Column:
    """Spans of both entropy kinds in candidates that mix letters and digits and aren't allow-listed."""
    found = F.filter(matches(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(ALLOWED))

    def of(m: Column) -> Column:
        hexed = m["value"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        spans = bound(F.when(hexed, HEX_BITS).otherwise(MIXED_BITS), lambda bits: bound(m["value"], lambda v: hot_windows(v, bits)))
        return bound(F.when(hexed, "entropy_hex").otherwise("entropy_mixed"), lambda kind: F.transform(spans, lambda w: F.struct((m["start"] + w["a"]).cast("long").alias("start"), F.lit(3).alias("k"), (m["start"] + w["b"]).cast("long").alias("end"), kind.alias("kind"))))

    return F.flatten(F.transform(found, of))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hexes, entropy) for every row: arrays of (start, k, end, kind) spans."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    long_enough = F.filter(matches(F.col("t"), ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6)
    return base.select("doc_id", _spans(long_enough, "assign", 0).alias("assign"), _spans(matches(F.col("t"), ACCESS), "access", 1).alias("access"), _spans(matches(F.col("t"), HEX), "hex", 2).alias("hexes"), entropy_spans(F.col("t")).alias("entropy"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    base = F.concat("assign", "access", "hexes")
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hexes").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, "entropy")).alias("spans"))
