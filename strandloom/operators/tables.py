"""Training logs and interval tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import ranges

# Line formats of a training log, and of names of model files.
MACROBATCH, LOSS, NAME = r"macrobatch (\d+)", r"loss: (\d+\.\d+)", r"k_(\d+)_s_(\d+)"


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def parse_log(lines: DataFrame, text: str = "line") -> DataFrame:
    return lines.withColumn("macrobatch", captured(F.col(text), MACROBATCH).cast("int")).withColumn("loss", captured(F.col(text), LOSS).cast("double"))


def read_log(spark: SparkSession, paths) -> DataFrame:
    """(file, line, macrobatch, loss) of the lines that name a macrobatch, from files or folders."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return parse_log(lines).where("macrobatch is not null")


def parse_name(name: Column) -> list[Column]:
    return [captured(name, NAME, 1).cast("int").alias("k"), captured(name, NAME, 2).cast("int").alias("stride")]


def epochs(rows: DataFrame, group: str, order: str, macrobatch: str, chunk: int = ranges.CHUNK) -> DataFrame:
    """rows with epoch: how often the macrobatch number jumped by more than one; the first is held against 0. A log of any length is dealt to several tasks."""
    lines = ranges.in_chunks(ranges.placed(rows, group, [F.col(order)], chunk), 1, 0, chunk)
    previous = F.lag(macrobatch, 1, 0).over(W.partitionBy(group, "_chunk").orderBy("pos"))
    jumps = lines.withColumn("_j", (F.abs(F.col(macrobatch) - previous) > 1).cast("int")).where("_own")
    summed = ranges.running_in_chunks(jumps, group, F.col("_j"), "_epoch", chunk)
    return summed.select(*rows.columns, F.col("_epoch").cast("int").alias("epoch"))


def geometric_mean(value: Column) -> Column:
    """Logs of positive values, over all rows."""
    return F.exp(F.sum(F.when(value > 0, F.log(value))) / F.count(F.lit(1)))


def width_bins(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n) of equal bins within [low, high]; values outside are left out."""
    inside = rows.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def read_intervals(spark: SparkSession, paths, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """A table of intervals from delimited files, with or without a header."""
    return spark.read.csv(paths, schema=schema, sep=sep, header=header)


def same_interval(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Rows of both tables that name the same interval."""
    return left.join(right, list(on))


def with_width(intervals: DataFrame, height: str = "height") -> DataFrame:
    """intervals with width and height_per_width."""
    sized = intervals.withColumn("width", F.col("end") - F.col("start"))
    return sized.withColumn("height_per_width", F.col(height) / F.col("width"))


def listed(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """rows whose value is in a short list, such as genes of interest."""
    return rows.where(F.col(column).isin(values))


def prefix_of(name: Column, separator: str = "_") -> Column:
    return F.substring_index(name, separator, 1)


def match_prefix(left: DataFrame, right: DataFrame, left_name: str, right_name: str, separator: str = "_", matched: bool = True) -> DataFrame:
    """Rows of left whose name's prefix some name of right has, or none has. Prefixes are few; right is reduced to them first."""
    prefixes = right.select(prefix_of(F.col(right_name), separator).alias("_prefix")).distinct()
    return left.join(prefixes, prefix_of(F.col(left_name), separator) == F.col("_prefix"), "left_semi" if matched else "left_anti")
