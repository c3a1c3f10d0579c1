"""Series as tables of samples: (series_id, sample_idx, value), and their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLOCK

#: Ranges of the order column within which rows are numbered.
RANGES = 64


def not_finite(value: Column) -> Column:
    """Whether a value is null, NaN or infinite."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def checked(value: Column) -> Column:
    """value, or an error where it is not finite."""
    return F.when(not_finite(value), F.raise_error(F.lit("input contains a non-finite value")).cast("float")).otherwise(value)


def range_cuts(df: DataFrame, x: Column, ranges: int = RANGES) -> list[float]:
    """Sorted cuts of a numeric column into ranges of about as many rows each; fewer where values repeat."""
    return sorted(set(df.select(x.alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.01))) if ranges > 1 else []


def range_of(x: Column, cuts: list[float], first: int = 0) -> Column:
    """How many sorted cuts are at or below x (0 where it is null), by halving.

    Not by filter() over the cuts: that computes x once for each, and Spark numbers a lambda's variables from 0 when it compares expressions, so
    it takes them for a session's first columns and puts filters of one side of a join on the other.
    """
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(x >= cuts[half], range_of(x, cuts[half + 1 :], first + half + 1)).otherwise(range_of(x, cuts[:half], first))


def samples(df: DataFrame, series: Column, order: Column, value: Column, *ties: Column, ranges: int = RANGES) -> DataFrame:
    """Number each series' rows from 0 in the order of a numeric ``order`` (then ``ties``).

    A plain row_number() would sort a whole series in one task. Here the order's quantiles cut all rows into ranges; rows are numbered within
    (series, range), and the counts of the ranges before are added. Only the counts, one per series and range, are windowed.
    """
    base = df.select(series.cast("string").alias("series_id"), order.alias("_order"), value.cast("float").alias("value"), *(t.alias(f"_tie{i}") for i, t in enumerate(ties)))
    place = range_of(F.col("_order").cast("double"), range_cuts(base, F.col("_order").cast("double"), ranges))
    base = base.withColumn("_range", place)
    counts = base.groupBy("series_id", "_range").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("series_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("series_id", "_range").orderBy("_order", *(f"_tie{i}" for i in range(len(ties))))
    numbered = base.withColumn("_nth", F.row_number().over(own)).join(before.drop("count"), ["series_id", "_range"])
    return numbered.select("series_id", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("sample_idx"), F.col("_order").alias("ts"), "value")


def with_blocks(df: DataFrame) -> DataFrame:
    """Add block_no and pos."""
    return df.withColumns({"block_no": F.expr(f"sample_idx div {BLOCK}"), "pos": (F.col("sample_idx") % BLOCK).cast("int")})


def block_arrays(df: DataFrame) -> DataFrame:
    """(series_id, block_no, start_sample, sample_count, values): one row per block, at most BLOCK samples each."""
    rows = with_blocks(df.withColumn("value", checked(F.col("value")))).groupBy("series_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    return rows.select("series_id", "block_no", (F.col("block_no") * BLOCK).alias("start_sample"), F.size("s").alias("sample_count"), F.col("s.value").alias("values"))


def block_index(df: DataFrame) -> DataFrame:
    """(series_id, block_no, start_sample, sample_count) of samples."""
    return with_blocks(df).groupBy("series_id", "block_no").agg(F.min("sample_idx").alias("start_sample"), F.count("*").alias("sample_count"))


def series_of_blocks(rows: DataFrame) -> DataFrame:
    """Long rows of blocks with values."""
    return rows.select("series_id", "start_sample", F.posexplode("values").alias("pos", "value")).select("series_id", (F.col("start_sample") + F.col("pos")).alias("sample_idx"), "value")
