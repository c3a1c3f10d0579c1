"""Block statistics as column functions: predictor choice, residuals, moments, histograms, frequencies, token runs.

Inputs are samples with block_no and pos. Every window is partitioned by block, so no task sorts more than a block's samples at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import BETA_MAX, BETA_MIN, BLOCK, RATIO_POINTS, SCALE, WINDOW

BLOCK_KEY = ["series_id", "block_no"]


def in_block() -> WindowSpec:
    return Window.partitionBy(*BLOCK_KEY).orderBy("pos")


def _f32(x: float) -> Column:
    return F.lit(x).cast("float")


def predictor_select(blocks: DataFrame) -> DataFrame:
    """(series_id, block_no, r1, r2, mode, harmonic) from the first 64 samples of each block."""
    head = blocks.where(F.col("pos") < WINDOW)
    mean = F.avg(F.col("value").cast("double")).over(Window.partitionBy(*BLOCK_KEY))
    c = head.withColumn("c", F.col("value").cast("double") - mean)
    lagged = c.withColumns({"c1": F.lag("c", 1).over(in_block()), "c2": F.lag("c", 2).over(in_block()), "x1": F.lag("value", 1).over(in_block()), "x2": F.lag("value", 2).over(in_block())})
    middle = F.col("x1").cast("double")
    sums = lagged.groupBy(*BLOCK_KEY).agg(
        F.count("*").alias("w"),
        F.sum(F.col("c") * F.col("c")).alias("energy"),
        F.sum(F.col("c") * F.col("c1")).alias("l1"),
        F.sum(F.col("c") * F.col("c2")).alias("l2"),
        F.sum(F.when(F.col("x2").isNotNull(), middle * (F.col("value") + F.col("x2")).cast("double"))).alias("up"),
        F.sum(F.when(F.col("x2").isNotNull(), 2.0 * middle * middle)).alias("down"),
    )
    ratio = lambda x: F.when(F.col("energy") > 0, F.coalesce(F.col(x), F.lit(0.0)) / F.col("energy")).otherwise(0.0)
    r = sums.withColumns({"r1": ratio("l1"), "r2": ratio("l2")})
    still = (F.col("energy") / F.col("w") < 1e-9) | (F.col("energy") == 0) | (F.abs("r1") < 0.25)
    tone = ~still & (2.0 * (1.0 - F.col("r1") * F.col("r1")) > 1e-4) & (F.col("r2") < 0.95 * F.col("r1"))
    clamp = lambda x: F.least(F.lit(0.999), F.greatest(F.lit(-0.999), x)).cast("float")
    first = clamp(F.col("r1") * (1.0 + F.col("r2")) / (2.0 * F.col("r2") + 1e-5))
    again = (F.abs(first) >= _f32(0.9989)) & (F.col("w") >= 3) & (F.col("down") > 1e-20)
    pole = F.when(again, clamp(F.col("up") / F.col("down"))).otherwise(first)
    return r.select(*BLOCK_KEY, "r1", "r2", F.when(still, 0).when(tone, 1).otherwise(2).alias("mode"), F.when(tone, pole).otherwise(_f32(0.0)).alias("harmonic"))


def open_loop_residuals(blocks: DataFrame, modes: DataFrame) -> DataFrame:
    """(series_id, block_no, pos, residual), in float arithmetic, from true history; history starts anew in every block."""
    x1, x2 = F.lag("value", 1).over(in_block()), F.lag("value", 2).over(in_block())
    rows = blocks.withColumns({"x1": x1, "x2": x2}).join(modes.select(*BLOCK_KEY, "mode", "harmonic"), BLOCK_KEY)
    two = _f32(2.0)
    guess = (
        F.when(F.col("pos") == 0, _f32(0.0))
        .when((F.col("pos") == 1) | (F.col("mode") == 0), F.col("x1"))
        .when(F.col("mode") == 1, two * F.col("harmonic") * F.col("x1") - F.col("x2"))
        .otherwise(two * F.col("x1") - F.col("x2"))
    )
    return rows.select(*BLOCK_KEY, "pos", (F.col("value") - guess).alias("residual"))


def ged_moments(residuals: DataFrame) -> DataFrame:
    """(series_id, block_no, n, mean, m1, m2, peak): centred absolute and squared means, and the greatest magnitude."""
    centred = residuals.withColumn("mean", F.avg(F.col("residual").cast("double")).over(Window.partitionBy(*BLOCK_KEY)).cast("float"))
    c = (F.col("residual") - F.col("mean")).cast("double")
    return centred.groupBy(*BLOCK_KEY).agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.avg(F.abs(c)).alias("m1"), F.avg(c * c).alias("m2"), F.max(F.abs("residual")).alias("peak"))


def _shape_table() -> tuple[list[float], list[float]]:
    """Ratios, and logarithms of gamma(1 / b) / gamma(3 / b), at the table's shapes b."""
    ratio, scale = [], []
    for i in range(RATIO_POINTS):
        b = BETA_MIN + (BETA_MAX - BETA_MIN) * i / (RATIO_POINTS - 1)
        g1, g2, g3 = (math.lgamma(k / b) for k in (1, 2, 3))
        ratio.append(math.exp(2 * g2 - g1 - g3))
        scale.append(g1 - g3)
    return ratio, scale


def ged_estimate(moments: DataFrame) -> DataFrame:
    """Add beta, alpha and peak_sigma (peak over standard deviation) by column functions.

    The shape comes from a table of 4,097 points, a literal of fixed size, by bisection and interpolation; blocks without variance are (0, 2).
    """
    ratio, scale = _shape_table()
    spark = moments.sparkSession
    table = F.broadcast(spark.createDataFrame([(ratio, scale)], "_r array<double>, _s array<double>"))
    own = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m1") * F.col("m1") / F.col("m2")))
    rows = moments.withColumn("_x", F.when(F.col("m2") > 1.1754943508222875e-38, own)).crossJoin(table)  # one row of fixed size
    powers = ", ".join(str(1 << k) for k in range(12, -1, -1))
    rows = rows.withColumn("_at", F.expr(f"aggregate(array({powers}), 0, (a, s) -> CASE WHEN a + s <= {RATIO_POINTS} AND element_at(_r, least(a + s, {RATIO_POINTS})) < _x THEN a + s ELSE a END)"))
    inside = f"least(greatest(_at, 1), {RATIO_POINTS - 1})"
    lo, hi = F.expr(f"element_at(_r, {inside})"), F.expr(f"element_at(_r, {inside} + 1)")
    fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_x") - lo) / (hi - lo)))
    rows = rows.withColumn("_f", F.when(F.col("_at") == 0, 0.0).when(F.col("_at") == RATIO_POINTS, 1.0).otherwise(fraction))
    step = (BETA_MAX - BETA_MIN) / (RATIO_POINTS - 1)
    beta = F.lit(BETA_MIN) + step * (F.expr(inside) - 1 + F.col("_f"))
    log_scale = F.expr(f"element_at(_s, {inside})") * (1 - F.col("_f")) + F.expr(f"element_at(_s, {inside} + 1)") * F.col("_f")
    flat = F.col("_x").isNull()
    return rows.withColumns(
        {
            "beta": F.when(flat, 2.0).otherwise(beta).cast("float"),
            "alpha": F.when(flat, 0.0).otherwise(F.sqrt(F.col("m2") * F.exp(log_scale))).cast("float"),
            "peak_sigma": F.when(flat, 0.0).otherwise(F.col("peak").cast("double") / F.sqrt("m2")),
        }
    ).drop("_x", "_r", "_s", "_at", "_f")


def impulsive(estimates: DataFrame) -> DataFrame:
    """blocks, triggered, block numbers, least beta and greatest peak over deviation of each series."""
    hit = (F.col("beta") < 0.8) & (F.col("peak_sigma") > 8)
    return estimates.groupBy("series_id").agg(F.count("*").alias("blocks"), F.count_if(hit).alias("triggered"), F.array_sort(F.collect_list(F.when(hit, F.col("block_no")))).alias("triggered_blocks"), F.min("beta").alias("min_beta"), F.max("peak_sigma").alias("max_peak_sigma"))


def histogram(symbols: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    return symbols.groupBy(*keys, symbol).agg(F.count("*").alias("n"))


def normalised_frequencies(counts: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """Add freq (sums to 4096 in each group) and cum (what is before a symbol). Alphabets have 256 symbols at most.

    What rounding down leaves goes to the largest remainders. What the minimum of one takes too much comes off the largest frequency, one at a time,
    the smaller symbol first in ties: a symbol's frequency falls through f, f - 1, ..., so the steps of a group are ranked by the frequency
    that they start from, and the first so many are taken.
    """
    group = Window.partitionBy(*keys)
    rows = counts.withColumn("_exact", F.col("n") / F.sum("n").over(group) * float(SCALE))
    rows = rows.withColumn("_floor", F.greatest(F.lit(1), F.floor("_exact")).cast("long"))
    rows = rows.withColumns({"_left": F.lit(SCALE) - F.sum("_floor").over(group), "_rank": F.row_number().over(group.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), symbol))})
    most = F.when(F.col("_left") < 0, F.least(F.col("_floor") - 1, -F.col("_left"))).otherwise(0)
    steps = F.when(most > 0, F.sequence(F.col("_floor") - most + 1, F.col("_floor"))).otherwise(F.array().cast("array<bigint>"))
    taken = rows.select(*keys, symbol, "_left", F.explode(steps).alias("_from")).withColumn("_turn", F.row_number().over(group.orderBy(F.desc("_from"), symbol)))
    off = taken.where(F.col("_turn") <= -F.col("_left")).groupBy(*keys, symbol).agg(F.count("*").alias("_off"))
    rows = rows.join(off, [*keys, symbol], "left")
    rows = rows.withColumn("freq", F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0) - F.coalesce("_off", F.lit(0)))
    return rows.withColumn("cum", (F.sum("freq").over(group.orderBy(symbol)) - F.col("freq"))).drop("_exact", "_floor", "_left", "_rank", "_off")


def entropy_bits(counts: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("bits"))


def cell_of(value: Column, bounds: Column, lower_ties: bool = False) -> Column:
    """Cells of a sorted array of boundaries; a value on a boundary is in the upper cell, or (lower_ties) the lower."""
    return F.size(F.filter(bounds, (lambda b: b < value) if lower_ties else (lambda b: b <= value)))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def leb_length(u: Column) -> Column:
    """Bytes of a non-negative long as LEB128."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(u >= (1 << (7 * k)), 1).otherwise(0)
    return out


def token_runs(quanta: DataFrame) -> DataFrame:
    """(series_id, block_no, start_pos, tag, amount): runs of zero quanta (tag 0) and folded quanta (tag 1), by gaps and islands."""
    zero = F.col("q") == 0
    island = F.when(zero, F.col("pos") - F.row_number().over(Window.partitionBy(*BLOCK_KEY, "_zero").orderBy("pos"))).otherwise(F.col("pos"))
    rows = quanta.withColumn("_zero", zero).withColumn("_island", island)
    made = rows.groupBy(*BLOCK_KEY, "_zero", "_island").agg(F.min("pos").alias("start_pos"), F.count("*").alias("_n"), F.min("q").alias("_q"))
    return made.select(*BLOCK_KEY, "start_pos", F.when(F.col("_zero"), 0).otherwise(1).alias("tag"), F.when(F.col("_zero"), F.col("_n")).otherwise(zigzag(F.col("_q").cast("long"))).alias("amount"))


def lagged(rows: DataFrame, value: str, most: int) -> DataFrame:
    """Add value_1 to value_<most>: what a series' samples before this one (by sample_idx) hold, null before the first.

    Windows are of one block; what they need of the block before is carried in as one row for each block, so no task sorts a series.
    """
    w = Window.partitionBy(*BLOCK_KEY).orderBy("sample_idx")
    rows = rows.withColumn("block_no", F.expr(f"sample_idx div {BLOCK}"))
    ends = rows.where(F.col("sample_idx") % BLOCK >= BLOCK - most).groupBy(*BLOCK_KEY).agg(*(F.max(F.when(F.col("sample_idx") % BLOCK == BLOCK - k, F.col(value))).alias(f"_end{k}") for k in range(1, most + 1)))
    rows = rows.join(ends.withColumn("block_no", F.col("block_no") + 1), BLOCK_KEY, "left")
    place = F.col("sample_idx") % BLOCK
    made = {}
    for k in range(1, most + 1):
        carried = F.lit(None)
        for p in range(k):  # sample p of a block: k steps back is the block before's sample k - p from its end
            carried = F.when(place == p, F.col(f"_end{k - p}")).otherwise(carried)
        made[f"{value}_{k}"] = F.when(place >= k, F.lag(value, k).over(w)).otherwise(carried)
    return rows.withColumns(made).drop("block_no", *(f"_end{k}" for k in range(1, most + 1)))


def running_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the running sum of a column by sample_idx: within blocks, plus the sums of the blocks before, so no task sums a series."""
    rows = rows.withColumn("block_no", F.expr(f"sample_idx div {BLOCK}"))
    sums = rows.groupBy(*BLOCK_KEY).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("series_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum(value).over(Window.partitionBy(*BLOCK_KEY).orderBy("sample_idx"))
    joined = rows.withColumn("_own", own).join(sums.select(*BLOCK_KEY, before.alias("_before")), BLOCK_KEY)
    return joined.withColumn(name, F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_own", "_before", "block_no")


def delta_of_delta(points: DataFrame, order: str = "ts") -> DataFrame:
    """Add delta and dod to points of (series_id, sample_idx); the first delta stands raw in dod, as a chunk writer stores it."""
    rows = lagged(points, order, 2)
    rows = rows.withColumn("delta", F.col(order) - F.col(f"{order}_1"))
    return rows.withColumn("dod", F.col("delta") - F.coalesce(F.col(f"{order}_1") - F.col(f"{order}_2"), F.lit(0))).drop(f"{order}_1", f"{order}_2")


def undo_delta_of_delta(rows: DataFrame, first: str = "first_ts") -> DataFrame:
    """ts from first timestamps and dod, by two running sums over sample_idx."""
    rows = running_sum(rows.withColumn("_dod", F.coalesce("dod", F.lit(0))), "_dod", "_delta")
    rows = running_sum(rows, "_delta", "_after")
    return rows.withColumn("ts", F.col(first) + F.col("_after")).drop("_dod", "_delta", "_after")
