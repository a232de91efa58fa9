"""Column functions on sequences and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters and their complements; other letters stay.
LETTERS, COMPLEMENTS = "ACGT", "TGCA"


def kmers(seq: Column, k: int, stride: int = 1) -> Column:
    """Array of the k-mers of a stripped sequence; empty where it is shorter than k; a remainder is dropped."""
    if k < 1 or stride < 1:
        raise ValueError("k and stride must be at least 1")
    # one pass over the sequence: each match captures k characters ahead and moves on by the stride
    return F.regexp_extract_all(F.trim(seq), F.lit(f"(?s)(?=(.{{{k}}})).{{1,{stride}}}"), F.lit(1))


def rejoin(parts: Column, k: int, stride: int = 1) -> Column:
    """The sequence that kmers came from, without a dropped remainder."""
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.substring(x, F.lit(k - stride + 1), F.lit(stride)))
    return F.when(F.size(parts) > 0, F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise("")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement: what names their class."""
    return F.least(kmer, reverse_complement(kmer))


def words(line: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(line, "[ \\t\\r\\n\\f]+"), lambda x: x != "")


def pseudo_dna(text: Column) -> Column:
    """ASCII letters of a text, upper-cased, each mapped to one of ACGT in turn of the alphabet."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
