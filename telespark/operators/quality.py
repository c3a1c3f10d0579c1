"""Quality reports and baseline codecs, as column functions where they can be."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import RANGES, range_cuts, range_of
from .stats import cell_of

#: Fixed value: standard gravity.
GRAVITY = 9.80665


def quality(pairs: DataFrame, keys: list[str], original: str = "value", decoded: str = "decoded") -> DataFrame:
    """samples, mse, psnr_db (infinite for equal series) and max_absolute_error by keys."""
    e = F.col(original).cast("double") - F.col(decoded).cast("double")
    rows = pairs.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(e * e).alias("mse"), F.max(F.abs(e)).alias("max_absolute_error"), (F.max(original).cast("double") - F.min(original).cast("double")).alias("_range"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.col("_range") * F.col("_range") / F.col("mse")))
    return rows.withColumn("psnr_db", psnr).drop("_range")


def normalise(samples: DataFrame, keys: list[str], value: str = "value", least: int = 64) -> DataFrame:
    """value less its series' mean, over the standard deviation, else the greatest magnitude, else 1; series under ``least`` samples fail.

    Means and deviations are aggregates, joined back: no task holds a series.
    """
    v = F.col(value).cast("double")
    sums = samples.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    top = F.greatest(F.col("_high") - F.col("_mean"), F.col("_mean") - F.col("_low"))
    scale = F.when(F.col("_sd") > 0, F.col("_sd")).when(top > 0, top).otherwise(1.0)
    rows = samples.join(sums.select(*keys, "_n", "_mean", scale.alias("_scale")), keys)
    made = F.when(F.col("_n") >= least, ((v - F.col("_mean")) / F.col("_scale")).cast("float")).otherwise(F.raise_error(F.lit("too few samples to normalise")).cast("float"))
    return rows.withColumn(value, made).drop("_n", "_mean", "_scale")


def peak_acceleration(samples: DataFrame, keys: list[str], sensitivity: float, value: str = "value") -> DataFrame:
    """The greatest magnitude in units of standard gravity."""
    return samples.groupBy(*keys).agg((F.max(F.abs(value)) / sensitivity / GRAVITY).alias("peak_g"))


def peak_gate(samples: DataFrame, keys: list[str], sensitivity: float, least_g: float = 0.5, value: str = "value") -> DataFrame:
    """The series whose peak acceleration is over ``least_g``."""
    return peak_acceleration(samples, keys, sensitivity, value).where(F.col("peak_g") > least_g)


def sizes(rows: DataFrame) -> DataFrame:
    """Add bits_per_sample and ratio to rows of samples (float32) and bytes."""
    return rows.withColumns({"bits_per_sample": F.col("bytes") * 8 / F.col("samples"), "ratio": F.col("samples") * 4 / F.col("bytes")})


def lloyd_levels(samples: DataFrame, levels: list[float], rounds: int, value: str = "value") -> list[float]:
    """Levels fitted to all samples: cells lie between the middles of neighbouring levels, and a level becomes its cell's mean; empty cells keep theirs.

    A round is one aggregate of as many rows as there are levels; the driver holds the levels only.
    """
    now = sorted(map(float, levels))
    v = F.col(value).cast("double")
    for _ in range(rounds):
        bounds = F.array(*(F.lit((a + b) / 2) for a, b in zip(now, now[1:], strict=False)))
        means = {r["cell"]: r["level"] for r in samples.groupBy(cell_of(v, bounds).alias("cell")).agg(F.avg(v).alias("level")).collect()}
        new = [means.get(k, x) for k, x in enumerate(now)]
        if new == now:
            break
        now = new
    return now


def write_results(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines or CSV with a header; infinite and undefined numbers become null."""
    finite = [finite_or_null(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name) for f in report.schema]
    writer = report.select(*finite).write.mode("overwrite")
    writer.json(path, ignoreNullFields=False) if kind == "json" else writer.csv(path, header=True)


def manifest(samples: DataFrame, source: str, unit: str, normalised: bool) -> DataFrame:
    """One row for each series: where it comes from, how many samples it has and over which range, to be written beside the data."""
    v = F.col("value").cast("double")
    rows = samples.groupBy("series_id").agg(F.count("*").alias("samples"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return rows.withColumns({"source": F.lit(source), "unit": F.lit(unit), "normalised": F.lit(normalised), "bytes": F.col("samples") * 4})


def rate_distortion(reports: DataFrame) -> DataFrame:
    """Means by requested rate."""
    return reports.groupBy("rate").agg(F.avg("bits_per_sample").alias("bits_per_sample"), F.avg("psnr_db").alias("psnr_db"), F.median("psnr_db").alias("median_psnr_db"), F.max("psnr_db").alias("best_psnr_db"))


def quantiles(samples: DataFrame, keys: list[str], at: list[float], value: str = "value", ranges: int = RANGES) -> DataFrame:
    """keys and levels: the exact quantiles of each series, interpolated as percentile() does; nulls don't count, and levels are null where nothing else is.

    No task holds a series' different values. Rows are counted by ranges of values, which tells the range of every wanted rank; only there
    are values counted, each once, and summed up in their order. The driver gets the numbers of the ranges that any series wants.
    """
    base = samples.select(*keys, F.col(value).cast("double").alias("_v"))
    base = base.withColumn("_range", range_of(F.col("_v"), range_cuts(base, F.col("_v"), ranges)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy(*keys, "_range").agg(F.count("_v").alias("_count"))
    counts = counts.withColumns({"_n": F.sum("_count").over(Window.partitionBy(*keys)), "_before": F.coalesce(F.sum("_count").over(before.partitionBy(*keys).orderBy("_range")), F.lit(0))})
    places = [(F.col("_n") - 1) * F.lit(float(q)) for q in at]
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in places for f in (F.floor, F.ceil))))
    within = lambda start, count: lambda r: (r >= start) & (r < start + count)
    hit = counts.withColumn("_ranks", F.filter(ranks, within(F.col("_before"), F.col("_count")))).where(F.size("_ranks") > 0)
    wanted = [r[0] for r in hit.select("_range").distinct().collect()]
    some = base.where(F.col("_v").isNotNull() & F.col("_range").isin(wanted)).groupBy(*keys, "_range", "_v").agg(F.count("*").alias("_same")).join(hit.drop("_count"), [*keys, "_range"])
    start = F.col("_before") + F.coalesce(F.sum("_same").over(before.partitionBy(*keys, "_range").orderBy("_v")), F.lit(0))
    found = some.withColumn("_start", start).withColumn("_rank", F.explode(F.filter("_ranks", within(F.col("_start"), F.col("_same")))))
    held = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def level(x: Column) -> Column:
        low, high = F.element_at("_at", F.floor(x).cast("long")), F.element_at("_at", F.ceil(x).cast("long"))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    made = held.select(*keys, F.array(*map(level, places)).alias("levels"))
    return counts.where("_n = 0").select(*keys).distinct().withColumn("levels", F.lit(None).cast("array<double>")).unionByName(made)


def uniform_quantile(samples: DataFrame, keys: list[str], bits: int, value: str = "value") -> DataFrame:
    """The baseline of 2**bits levels at even quantiles with midpoint boundaries: adds cell and decoded."""
    k = 1 << bits
    levels = quantiles(samples, keys, [(i + 0.5) / k for i in range(k)], value)
    bounds = F.transform(F.slice("levels", 1, k - 1), lambda x, i: (x + F.element_at("levels", i + 2)) / 2)
    rows = samples.join(levels.withColumn("bounds", bounds), keys)
    cell = cell_of(F.col(value).cast("double"), F.col("bounds"))
    return rows.withColumn("cell", cell).withColumn("decoded", F.element_at("levels", F.col("cell") + 1)).drop("levels", "bounds")


def uniform_bytes(n: Column, bits: int) -> Column:
    return F.ceil(n * bits / 8) + 4 * (1 << bits)


def shuffle_bytes(values: np.ndarray) -> bytes:
    """The four byte planes of float32 values in a row."""
    return np.asarray(values, "<f4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unshuffle_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<f4").ravel()


def lossless(values: np.ndarray, level: int = 3) -> bytes:
    """The lossless baseline: byte planes under zstandard where it is installed, else deflate; the first byte tells which."""
    planes = shuffle_bytes(values)
    try:
        import zstandard
    except ImportError:
        return b"d" + struct.pack("<Q", len(planes)) + zlib.compress(planes, level)
    return b"z" + struct.pack("<Q", len(planes)) + zstandard.ZstdCompressor(level=level).compress(planes)


def undo_lossless(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return unshuffle_bytes(zlib.decompress(data[9:]))
    import zstandard

    return unshuffle_bytes(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=struct.unpack_from("<Q", data, 1)[0]))


def finite_or_null(c: Column) -> Column:
    """For JSON reports, which have no infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
