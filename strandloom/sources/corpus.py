"""Readers of sequence corpora: FASTA, FASTQ and white-space text files, plain or gzip.

Records are split by Spark's text source with a record separator, so uncompressed files are
read in splits. Every reader gives (file, id, seq, ok) or (file, tokens); rows with ok false are malformed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.functions.tokens import kmers, words


def _records(spark: SparkSession, paths, separator: str, skip: list[str] | None, suffix: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", recursive)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    df = reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return without(df, "file", skip or [])


def without(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """rows whose column none of the patterns matches anywhere."""
    for pattern in patterns:
        rows = rows.where(~F.col(column).rlike(pattern))
    return rows


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def file_label(file: Column) -> Column:
    """The base name up to its first underscore."""
    return F.element_at(F.split(base_name(file), "_"), 1)


def read_fasta(spark: SparkSession, paths, skip=None, suffix=None, promote: bool = True, multiline: bool = False, recursive: bool = False) -> DataFrame:
    """(file, id, seq, ok): one row a record.

    Well formed are records of one sequence line, with or without a blank line after it; with multiline,
    sequence lines are joined instead. promote upper-cases sequences.
    """
    df = _records(spark, paths, "\n>", skip, suffix, recursive)
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\r?\n"), lambda x: F.trim(x))
    df = df.where(F.length(F.trim("value")) > 0).withColumn("lines", lines)
    body = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    filled = F.filter(body, lambda x: x != "")
    seq = F.array_join(filled, "") if multiline else F.element_at("lines", 2)
    ok = F.size(filled) >= 1 if multiline else (F.size("lines") == 2) | ((F.size("lines") >= 3) & (F.size(filled) == 1) & (F.element_at("lines", 2) != ""))
    seq = F.when(ok, F.upper(seq) if promote else seq)
    return df.select("file", F.element_at("lines", 1).alias("id"), seq.alias("seq"), F.coalesce(ok, F.lit(False)).alias("ok"))


def read_fastq(spark: SparkSession, paths, skip=None, suffix=None, marker: str = "@HISEQ", recursive: bool = False) -> DataFrame:
    """(file, id, seq, quality, ok): records start at a line with the marker and have four lines; case stays."""
    df = _records(spark, paths, f"\n{marker}", skip, suffix, recursive)
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    df = df.where(F.length(F.trim("value")) > 0).withColumn("lines", lines)
    ok = F.size("lines") == 4
    first = F.element_at("lines", 1)
    name = F.when(first.startswith("@"), first).otherwise(F.concat(F.lit(marker), first))
    return df.select("file", name.alias("id"), F.when(ok, F.element_at("lines", 2)).alias("seq"), F.when(ok, F.element_at("lines", 4)).alias("quality"), ok.alias("ok"))


def read_raw_lines(spark: SparkSession, paths, skip=None, suffix=None, recursive: bool = False) -> DataFrame:
    """(file, value)."""
    return _records(spark, paths, "\n", skip, suffix, recursive).select("file", "value")


def read_lines(spark: SparkSession, paths, skip=None, suffix=None, recursive: bool = False) -> DataFrame:
    """(file, tokens): one sentence a line; blank lines give empty sentences."""
    return read_raw_lines(spark, paths, skip, suffix, recursive).select("file", words(F.col("value")).alias("tokens"))


def read_corpus(spark: SparkSession, paths, parser: str | Callable[[Column], Column] = "text", k: int | None = None, stride: int = 1, **options) -> DataFrame:
    """(file, tokens) by the parser's name: one that holds ``fastq``, then ``fasta``, else white-space text.

    A parser may also be a function that makes the Column of tokens from the Column of a line.
    """
    if callable(parser):
        return read_raw_lines(spark, paths, **options).select("file", parser(F.col("value")).alias("tokens"))
    if "fastq" in parser or "fasta" in parser:
        if k is None:
            raise ValueError("k is needed for sequence files")
        df = (read_fastq if "fastq" in parser else read_fasta)(spark, paths, **options)
        return df.where("ok").select("file", kmers(F.col("seq"), k, stride).alias("tokens"))
    return read_lines(spark, paths, **options)


def bad_records(df: DataFrame) -> DataFrame:
    """Files and counts of malformed records."""
    return df.where("not ok").groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))


def positive_files(df: DataFrame) -> DataFrame:
    return df.where(base_name(F.col("file")).endswith("pos.fasta"))


def negative_files(df: DataFrame) -> DataFrame:
    return df.where(base_name(F.col("file")).endswith("neg.fasta"))
