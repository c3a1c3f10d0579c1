"""Queries by name. Each runs an operator over whole tables; ORACLES has the same rows as SQL.

Series: E is events by time, Et events by type, Eu events by user, O orders by key, V the embeddings' vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BLOCK, CodecConfig
from ..operators import blocks as block_ops
from ..operators import quality as quality_ops
from ..operators import series as series_ops
from ..operators import stats
from ..session import ready, table

BLOCK_KEY = stats.BLOCK_KEY


def micros(ts: str = "ts") -> Column:
    """Microseconds of a time without zone, whatever the session's zone."""
    return F.expr(f"unix_date(CAST({ts} AS DATE)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def events(spark: SparkSession, sf_dir: str, key: Column | None = None) -> DataFrame:
    return series_ops.samples(table(spark, sf_dir, "events"), F.lit("E") if key is None else key, micros(), F.col("value"), F.col("event_id"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.samples(table(spark, sf_dir, "orders"), F.lit("O"), F.col("o_orderkey"), F.col("o_totalprice"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("sample_idx", "value"))
    return rows.select("series_id", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("sample_idx").cast("long").alias("ts"), "value")


def by(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: events(spark, sf_dir, F.col(name).cast("string"))


SERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"E": events, "Et": by("event_type"), "Eu": by("user_id"), "O": orders, "V": vectors}

#: SQL for the same series.
SERIES_SQL = {
    "E": "SELECT 'E' AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS sample_idx, epoch_us(ts) AS ts, CAST(value AS FLOAT) AS value FROM events",
    "Et": "SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_idx, epoch_us(ts) AS ts, CAST(value AS FLOAT) AS value FROM events",
    "Eu": "SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, epoch_us(ts) AS ts, CAST(value AS FLOAT) AS value FROM events",
    "O": "SELECT 'O' AS series_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_idx, o_orderkey AS ts, CAST(o_totalprice AS FLOAT) AS value FROM orders",
    "V": "SELECT CAST(vec_id AS VARCHAR) AS series_id, i AS sample_idx, i AS ts, embedding[i + 1] AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def with_sql(which: str, rest: str) -> str:
    """SQL over s (samples with block_no and pos)."""
    return f"WITH raw AS ({SERIES_SQL[which]}), s AS (SELECT *, CAST(sample_idx AS BIGINT) // {BLOCK} AS block_no, CAST(sample_idx % {BLOCK} AS INTEGER) AS pos FROM raw){rest}"


def over(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.with_blocks(SERIES[which](spark, sf_dir))


# ---- blocks -------------------------------------------------------------------------------------------------------------------------

for _w in ("E", "Et", "O"):
    query(f"block_assign_{_w.lower()}", with_sql(_w, " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, CAST(block_no AS BIGINT) AS block_no, pos FROM s"))(
        lambda spark, sf_dir, w=_w: over(w, spark, sf_dir).select("series_id", "sample_idx", "block_no", "pos")
    )
    query(
        f"block_index_{_w.lower()}",
        with_sql(_w, " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, CAST(min(sample_idx) AS BIGINT) AS start_sample, count(*) AS sample_count FROM s GROUP BY ALL"),
    )(lambda spark, sf_dir, w=_w: series_ops.block_index(SERIES[w](spark, sf_dir)))

# ---- predictor, residuals, shape -----------------------------------------------------------------------------------------------------

_PREDICTOR = """, head AS (SELECT *, CAST(value AS DOUBLE) - avg(CAST(value AS DOUBLE)) OVER (PARTITION BY series_id, block_no) AS c FROM s WHERE pos < 64),
    lagged AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM head WINDOW w AS (PARTITION BY series_id, block_no ORDER BY pos)),
    sums AS (SELECT series_id, block_no, count(*) AS w, sum(c * c) AS energy, coalesce(sum(c * c1), 0) AS l1, coalesce(sum(c * c2), 0) AS l2,
        sum(CASE WHEN x2 IS NOT NULL THEN CAST(x1 AS DOUBLE) * CAST(value + x2 AS DOUBLE) END) AS up,
        sum(CASE WHEN x2 IS NOT NULL THEN CAST(2.0 AS DOUBLE) * CAST(x1 AS DOUBLE) * CAST(x1 AS DOUBLE) END) AS down FROM lagged GROUP BY series_id, block_no),
    r AS (SELECT *, CASE WHEN energy > 0 THEN l1 / energy ELSE 0 END AS r1, CASE WHEN energy > 0 THEN l2 / energy ELSE 0 END AS r2 FROM sums),
    kind AS (SELECT *, (energy / w < 1e-9 OR energy = 0 OR abs(r1) < 0.25) AS still, (2.0 * (1.0 - r1 * r1) > 1e-4 AND r2 < 0.95 * r1) AS tone,
        CAST(least(0.999, greatest(-0.999, r1 * (1.0 + r2) / (2.0 * r2 + 1e-5))) AS FLOAT) AS first FROM r),
    modes AS (SELECT series_id, block_no, r1, r2, CAST(CASE WHEN still THEN 0 WHEN tone THEN 1 ELSE 2 END AS INTEGER) AS mode,
        CAST(CASE WHEN still OR NOT tone THEN 0 WHEN abs(first) >= 0.9989 AND w >= 3 AND down > 1e-20 THEN least(0.999, greatest(-0.999, up / down)) ELSE first END AS FLOAT) AS harmonic FROM kind)"""
_RESIDUALS = _PREDICTOR + """, history AS (SELECT s.*, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY series_id, block_no ORDER BY pos)),
    resid AS (SELECT h.series_id, h.block_no, h.pos, CAST(h.value - CASE WHEN pos = 0 THEN CAST(0 AS FLOAT) WHEN pos = 1 OR mode = 0 THEN x1
        WHEN mode = 1 THEN CAST(2 AS FLOAT) * harmonic * x1 - x2 ELSE CAST(2 AS FLOAT) * x1 - x2 END AS FLOAT) AS residual FROM history h JOIN modes USING (series_id, block_no))"""
_MOMENTS = _RESIDUALS + """, centred AS (SELECT *, CAST(avg(CAST(residual AS DOUBLE)) OVER (PARTITION BY series_id, block_no) AS FLOAT) AS mean FROM resid),
    moments AS (SELECT series_id, block_no, count(*) AS n, avg(abs(CAST(residual - mean AS DOUBLE))) AS m1, avg(CAST(residual - mean AS DOUBLE) * CAST(residual - mean AS DOUBLE)) AS m2, max(abs(residual)) AS peak FROM centred GROUP BY series_id, block_no)"""
_SHAPES = _MOMENTS + """, shapes AS (SELECT i, b, exp(2 * lgamma(2 / b) - lgamma(1 / b) - lgamma(3 / b)) AS ratio FROM (SELECT i, CAST(0.2 AS DOUBLE) + CAST(4.8 AS DOUBLE) * i / 4096 AS b FROM range(4097) t(i))),
    steps AS (SELECT b, ratio, lead(b) OVER (ORDER BY i) AS b2, lead(ratio) OVER (ORDER BY i) AS ratio2 FROM shapes),
    found AS (SELECT m.*, CASE WHEN m2 <= 1.1754943508222875e-38 THEN 2 WHEN least(1, m1 * m1 / m2) <= (SELECT min(ratio) FROM shapes) THEN 0.2 WHEN least(1, m1 * m1 / m2) >= (SELECT max(ratio) FROM shapes) THEN 5
        ELSE (SELECT b + (b2 - b) * (m1 * m1 / m2 - ratio) / (ratio2 - ratio) FROM steps WHERE ratio < m1 * m1 / m2 AND ratio2 >= m1 * m1 / m2) END AS beta FROM moments m),
    estimates AS (SELECT *, CASE WHEN m2 <= 1.1754943508222875e-38 THEN 0 ELSE peak / sqrt(m2) END AS peak_sigma, CASE WHEN m2 > 1.1754943508222875e-38 THEN 0.5 * (ln(m2) + lgamma(1 / beta) - lgamma(3 / beta)) END AS ln_alpha FROM found)"""


def modes_of(which: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = over(which, spark, sf_dir)
    return rows, stats.predictor_select(rows)


def moments_of(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ged_moments(stats.open_loop_residuals(*modes_of(which, spark, sf_dir)))


for _w in ("E", "Et", "O", "V"):
    query(f"predictor_select_{_w.lower()}", with_sql(_w, _PREDICTOR + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, mode, round(r1, 6) AS r1, round(CAST(harmonic AS DOUBLE), 4) AS harmonic FROM modes"))(
        lambda spark, sf_dir, w=_w: modes_of(w, spark, sf_dir)[1].select(*BLOCK_KEY, F.col("mode").cast("int").alias("mode"), F.round("r1", 6).alias("r1"), F.round(F.col("harmonic").cast("double"), 4).alias("harmonic"))
    )
    query(f"ged_moments_{_w.lower()}", with_sql(_w, _MOMENTS + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, n, round(ln(m1), 6) AS ln_m1, round(ln(m2), 6) AS ln_m2, CAST(peak AS DOUBLE) AS peak FROM moments"))(
        lambda spark, sf_dir, w=_w: moments_of(w, spark, sf_dir).select(*BLOCK_KEY, "n", F.round(F.ln("m1"), 6).alias("ln_m1"), F.round(F.ln("m2"), 6).alias("ln_m2"), F.col("peak").cast("double").alias("peak"))
    )
    query(f"ged_estimate_{_w.lower()}", with_sql(_w, _SHAPES + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, round(CAST(beta AS DOUBLE), 3) AS beta, round(ln_alpha, 3) AS ln_alpha, round(CAST(peak_sigma AS DOUBLE), 4) AS peak_sigma FROM estimates"))(
        lambda spark, sf_dir, w=_w: stats.ged_estimate(moments_of(w, spark, sf_dir)).select(*BLOCK_KEY, F.round(F.col("beta").cast("double"), 3).alias("beta"), F.round(F.ln(F.col("alpha").cast("double")), 3).alias("ln_alpha"), F.round("peak_sigma", 4).alias("peak_sigma"))
    )

for _w in ("E", "O"):
    query(f"open_loop_residuals_{_w.lower()}", with_sql(_w, _RESIDUALS + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, pos, CAST(residual AS DOUBLE) AS residual FROM resid"))(
        lambda spark, sf_dir, w=_w: stats.open_loop_residuals(*modes_of(w, spark, sf_dir)).select(*BLOCK_KEY, "pos", F.col("residual").cast("double").alias("residual"))
    )


@query(
    "impulsive_blocks",
    with_sql("Et", _SHAPES + " SELECT series_id, count(*) AS blocks, count(*) FILTER (beta < 0.8 AND peak_sigma > 8) AS triggered, round(min(CAST(beta AS DOUBLE)), 3) AS min_beta, round(max(CAST(peak_sigma AS DOUBLE)), 4) AS max_peak_sigma FROM estimates GROUP BY series_id"),
)
def impulsive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.impulsive(stats.ged_estimate(moments_of("Et", spark, sf_dir)))
    return rows.select("series_id", "blocks", "triggered", F.round(F.col("min_beta").cast("double"), 3).alias("min_beta"), F.round("max_peak_sigma", 4).alias("max_peak_sigma"))


# ---- symbols and frequencies ------------------------------------------------------------------------------------------------------------

_SYMBOLS = ", sym AS (SELECT series_id, block_no, CAST(floor(CAST(value AS DOUBLE)) AS BIGINT) % 16 AS symbol FROM s), hist AS (SELECT series_id, block_no, symbol, count(*) AS n FROM sym GROUP BY ALL)"
_FREQ = _SYMBOLS + """, ex AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, block_no) * 4096 AS exact FROM hist), fl AS (SELECT *, greatest(1, CAST(floor(exact) AS BIGINT)) AS f0 FROM ex),
    rk AS (SELECT *, 4096 - sum(f0) OVER (PARTITION BY series_id, block_no) AS spare, row_number() OVER (PARTITION BY series_id, block_no ORDER BY exact - floor(exact) DESC, symbol) AS k FROM fl),
    fr AS (SELECT series_id, block_no, symbol, n, CAST(f0 + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS freq FROM rk)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over("O", spark, sf_dir).select(*BLOCK_KEY, (F.floor(F.col("value").cast("double")) % 16).alias("symbol"))


@query("symbol_histogram", with_sql("O", _SYMBOLS + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, symbol, n FROM hist"))
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(symbols(spark, sf_dir), BLOCK_KEY)


@query("freq_normalize", with_sql("O", _FREQ + " SELECT series_id, CAST(block_no AS BIGINT) AS block_no, symbol, freq, CAST(sum(freq) OVER (PARTITION BY series_id, block_no ORDER BY symbol) - freq AS BIGINT) AS cum FROM fr"))
def freq_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.normalised_frequencies(symbol_histogram(spark, sf_dir), BLOCK_KEY)
    return rows.select(*BLOCK_KEY, "symbol", F.col("freq").cast("long").alias("freq"), F.col("cum").cast("long").alias("cum"))


@query("entropy_bits", with_sql("O", _SYMBOLS + ", p AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, block_no) AS p FROM hist) SELECT series_id, CAST(block_no AS BIGINT) AS block_no, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY series_id, block_no"))
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entropy_bits(symbol_histogram(spark, sf_dir), BLOCK_KEY).select(*BLOCK_KEY, F.round("bits", 6).alias("bits"))


# ---- quantizers -----------------------------------------------------------------------------------------------------------------------------

_BOUNDS = [20_000.0 * k for k in range(1, 16)]
_LEVELS = [20_000.0 * k + 10_000.0 for k in range(16)]
_CELLS = f", cells AS (SELECT *, CAST(len(list_filter(CAST({_BOUNDS} AS DOUBLE[]), lambda b: b <= CAST(value AS DOUBLE))) AS INTEGER) AS cell FROM s)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over("O", spark, sf_dir).withColumn("cell", stats.cell_of(F.col("value").cast("double"), F.array(*map(F.lit, _BOUNDS))))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("decoded", F.element_at(F.array(*map(F.lit, _LEVELS)), F.col("cell") + 1))


@query("quantize_exact", with_sql("O", _CELLS + " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, cell FROM cells"))
def quantize_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("series_id", "sample_idx", "cell")


@query("dequantize", with_sql("O", _CELLS + f" SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, CAST({_LEVELS} AS DOUBLE[])[cell + 1] AS decoded FROM cells"))
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select("series_id", "sample_idx", "decoded")


@query("codebook_join", with_sql("O", _CELLS + f" SELECT c.series_id, CAST(c.sample_idx AS BIGINT) AS sample_idx, b.level FROM cells c JOIN (SELECT i AS cell, CAST({_LEVELS} AS DOUBLE[])[i + 1] AS level FROM range(16) t(i)) b USING (cell)"))
def codebook_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = spark.createDataFrame(list(enumerate(_LEVELS)), "cell int, level double")
    return cells(spark, sf_dir).join(F.broadcast(book), "cell").select("series_id", "sample_idx", "level")


@query("per_cell_mean", with_sql("O", _CELLS + " SELECT cell, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 3) AS level FROM cells GROUP BY cell"))
def per_cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("double")), 3).alias("level"))


def _quantile_sql(bits: int) -> str:
    k = 1 << bits
    at = [(i + 0.5) / k for i in range(k)]
    return f"""q AS (SELECT series_id, quantile_cont(CAST(value AS DOUBLE), {at}) AS levels FROM s GROUP BY series_id), b AS (SELECT *, list_transform(range(1, {k}), lambda i: (levels[i] + levels[i + 1]) / 2) AS bounds FROM q),
        u AS (SELECT s.series_id, s.sample_idx, CAST(s.value AS DOUBLE) AS value, levels, CAST(len(list_filter(bounds, lambda x: x <= CAST(s.value AS DOUBLE))) AS INTEGER) AS cell FROM s JOIN b USING (series_id)), d AS (SELECT *, levels[cell + 1] AS decoded FROM u)"""


@query("uniform_quantile_codec", with_sql("O", ", " + _quantile_sql(3) + " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, cell, round(decoded, 3) AS decoded FROM d"))
def uniform_quantile_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ops.uniform_quantile(orders(spark, sf_dir), ["series_id"], 3).select("series_id", "sample_idx", "cell", F.round("decoded", 3).alias("decoded"))


_PSNR = "round(10 * log10(power(max(value) - min(value), 2) / avg(power(value - decoded, 2))), 5)"


@query(
    "rd_summary",
    " UNION ALL ".join(f"SELECT * FROM ({with_sql('Et', ', ' + _quantile_sql(bits) + f', p AS (SELECT series_id, {_PSNR} AS psnr_db FROM d GROUP BY series_id) SELECT CAST({bits} AS INTEGER) AS rate, round(avg(psnr_db), 3) AS psnr_db, round(max(psnr_db), 3) AS best_psnr_db FROM p')})" for bits in (2, 3, 4)),
)
def rd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").cast("string").alias("series_id"), F.col("value").cast("float").alias("value"))  # no number is needed here
    parts = [quality_ops.quality(quality_ops.uniform_quantile(rows, ["series_id"], bits), ["series_id"]).select(F.lit(bits).alias("rate"), F.lit(float(bits)).alias("bits_per_sample"), F.round("psnr_db", 5).alias("psnr_db")) for bits in (2, 3, 4)]
    made = quality_ops.rate_distortion(parts[0].union(parts[1]).union(parts[2]))
    return made.select("rate", F.round("psnr_db", 3).alias("psnr_db"), F.round("best_psnr_db", 3).alias("best_psnr_db"))


@query("quality_metrics", with_sql("O", _CELLS + f", d AS (SELECT CAST(value AS DOUBLE) AS value, CAST({_LEVELS} AS DOUBLE[])[cell + 1] AS decoded FROM cells) SELECT 'O' AS series_id, count(*) AS samples, round(ln(avg(power(value - decoded, 2))), 6) AS ln_mse, {_PSNR} AS psnr_db, max(abs(value - decoded)) AS max_absolute_error FROM d"))
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_ops.quality(decoded(spark, sf_dir), ["series_id"])
    return made.select("series_id", "samples", F.round(F.ln("mse"), 6).alias("ln_mse"), F.round("psnr_db", 5).alias("psnr_db"), "max_absolute_error")


@query("normalize_series", with_sql("Et", ", m AS (SELECT *, CAST(value AS DOUBLE) - avg(CAST(value AS DOUBLE)) OVER w AS c, stddev_pop(CAST(value AS DOUBLE)) OVER w AS sd FROM s WINDOW w AS (PARTITION BY series_id)) SELECT series_id, count(*) AS n, round(min(c / sd), 4) AS low, round(max(c / sd), 4) AS high, round(avg(c * c / sd / sd), 4) AS power FROM m GROUP BY series_id"))
def normalize_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("double")
    rows = quality_ops.normalise(SERIES["Et"](spark, sf_dir), ["series_id"])
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v * v), 4).alias("power"))


@query("peak_acceleration", with_sql("Et", " SELECT series_id, round(max(abs(CAST(value AS DOUBLE))) / 213979.6422 / 9.80665, 10) AS peak_g FROM s GROUP BY series_id"))
def peak_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SERIES["Et"](spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return quality_ops.peak_acceleration(rows, ["series_id"], 213979.6422).select("series_id", F.round("peak_g", 10).alias("peak_g"))


@query("head_truncation", with_sql("Et", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, CAST(value AS DOUBLE) AS value FROM s WHERE sample_idx < 100"))
def head_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 samples of each series, which is the operator."""
    return SERIES["Et"](spark, sf_dir).where("sample_idx < 100").select("series_id", "sample_idx", F.col("value").cast("double").alias("value"))


# ---- integers: tokens, folding, timestamps ---------------------------------------------------------------------------------------------------

_QUANTA = ", q AS (SELECT series_id, block_no, pos, CAST(floor(CAST(value AS DOUBLE) / 60) AS BIGINT) - 1 AS q FROM s)"
_FOLD = "CASE WHEN q >= 0 THEN 2 * q ELSE -2 * q - 1 END"


def quanta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over("E", spark, sf_dir).select(*BLOCK_KEY, "pos", (F.floor(F.col("value").cast("double") / 60) - 1).alias("q"))


@query(
    "zero_run_tokens",
    with_sql("E", _QUANTA + f", g AS (SELECT *, q = 0 AS z, CASE WHEN q = 0 THEN pos - row_number() OVER (PARTITION BY series_id, block_no, q = 0 ORDER BY pos) ELSE pos END AS island FROM q) SELECT series_id, CAST(block_no AS BIGINT) AS block_no, min(pos) AS start_pos, CAST(CASE WHEN z THEN 0 ELSE 1 END AS INTEGER) AS tag, CAST(CASE WHEN z THEN count(*) ELSE min({_FOLD}) END AS BIGINT) AS amount FROM g GROUP BY series_id, block_no, z, island"),
)
def zero_run_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_runs(quanta(spark, sf_dir)).select(*BLOCK_KEY, "start_pos", F.col("tag").cast("int").alias("tag"), F.col("amount").cast("long").alias("amount"))


@query("zigzag_leb", with_sql("E", f", d AS (SELECT ts, CAST(ts - 2 * lag(ts, 1, 0) OVER (ORDER BY ts) + lag(ts, 2, 0) OVER (ORDER BY ts) AS BIGINT) AS q FROM s), f AS (SELECT ts, q, {_FOLD} AS folded FROM d) SELECT ts, q, CAST(folded AS BIGINT) AS folded, CAST(1 + (folded >= 128)::INT + (folded >= 16384)::INT + (folded >= 2097152)::INT + (folded >= 268435456)::INT + (folded >= 34359738368)::INT + (folded >= 4398046511104)::INT + (folded >= 562949953421312)::INT + (folded >= 72057594037927936)::INT AS INTEGER) AS leb_bytes FROM f"))
def zigzag_leb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.lagged(events(spark, sf_dir), "ts", 2)
    rows = rows.select("ts", (F.col("ts") - 2 * F.coalesce("ts_1", F.lit(0)) + F.coalesce("ts_2", F.lit(0))).alias("q"))
    folded = stats.zigzag(F.col("q"))
    return rows.select("ts", "q", folded.alias("folded"), stats.leb_length(folded).cast("int").alias("leb_bytes"))


_DOD = ", d AS (SELECT series_id, sample_idx, ts, ts - lag(ts) OVER w AS delta FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts)), dd AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY series_id ORDER BY ts), 0) AS dod FROM d)"


@query("delta_of_delta", with_sql("Et", _DOD + " SELECT series_id, ts, delta, dod FROM dd"))
def delta_of_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.delta_of_delta(SERIES["Et"](spark, sf_dir)).select("series_id", "ts", "delta", "dod")


@query("dod_inverse", with_sql("Et", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, ts FROM s"))
def dod_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SERIES["Et"](spark, sf_dir)
    first = rows.where("sample_idx = 0").select("series_id", F.col("ts").alias("first_ts"))
    return stats.undo_delta_of_delta(stats.delta_of_delta(rows).drop("ts").join(first, "series_id")).select("series_id", "sample_idx", "ts")


@query("ts_monotonic", with_sql("Eu", _DOD + " SELECT series_id, count(*) AS points, bool_and(coalesce(delta > 0, TRUE)) AS rising FROM dd GROUP BY series_id"))
def ts_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.delta_of_delta(SERIES["Eu"](spark, sf_dir))
    return rows.groupBy("series_id").agg(F.count("*").alias("points"), F.bool_and(F.coalesce(F.col("delta") > 0, F.lit(True))).alias("rising"))


# ---- the codec -------------------------------------------------------------------------------------------------------------------------------

#: Whole numbers come back within a quarter, so rounding restores them.
WHOLE = CodecConfig(absolute_error=0.25, enable_index=True)
FINE = CodecConfig(absolute_error=0.01)
RATED = CodecConfig(target_rate=3.0, enable_index=True)


def whole(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return SERIES[which](spark, sf_dir).withColumn("value", F.floor("value").cast("float"))


@query("slice_fetch", with_sql("E", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, floor(CAST(value AS DOUBLE)) AS value FROM s WHERE sample_idx BETWEEN 4000 AND 4511"))
def slice_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """512 samples of a compressed series, which is the operator."""
    return block_ops.decode_slice(block_ops.encode_blocks(whole("E", spark, sf_dir), WHOLE), 4000, 512).select("series_id", "sample_idx", F.rint("value").alias("value"))


_REQUESTS = [(1, "E", 0, 1), (2, "E", 17, 301), (3, "E", 2025, 97), (4, "E", 4096, 2048), (5, "E", 6143, 105)]


@query("multi_slice_interval_join", with_sql("E", f", r AS (SELECT * FROM (VALUES {', '.join(f'({a}, {c}, {d})' for a, _, c, d in _REQUESTS)}) t(request_id, start, n)) SELECT CAST(request_id AS BIGINT) AS request_id, CAST(sample_idx AS BIGINT) AS sample_idx, floor(CAST(value AS DOUBLE)) AS value FROM s JOIN r ON sample_idx >= start AND sample_idx < start + n"))
def multi_slice_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_REQUESTS, "request_id long, series_id string, start long, count long")
    made = block_ops.decode_slices(block_ops.encode_blocks(whole("E", spark, sf_dir), WHOLE), asked)
    return made.select("request_id", "sample_idx", F.rint("value").alias("value"))


@query("decode_lossless_lattice", with_sql("Et", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, floor(CAST(value AS DOUBLE)) AS value FROM s"))
def decode_lossless_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ops.decode_series(block_ops.encode_blocks(whole("Et", spark, sf_dir), WHOLE)).select("series_id", "sample_idx", F.rint("value").alias("value"))


def pairs(which: str, config: CodecConfig, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SERIES[which](spark, sf_dir)
    back = block_ops.decode_series(block_ops.encode_blocks(rows, config)).withColumnRenamed("value", "decoded")
    return rows.join(back, ["series_id", "sample_idx"], "left")


def _holds(which: str) -> str:
    return with_sql(which, " SELECT series_id, count(*) AS samples, TRUE AS holds FROM s GROUP BY series_id")


@query("error_bound_holds", _holds("Eu"))
def error_bound_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_ops.quality(pairs("Eu", FINE, spark, sf_dir), ["series_id"])
    return made.select("series_id", "samples", (F.coalesce("max_absolute_error", F.lit(9.0)) <= 0.01 * 1.0001 + 1e-4).alias("holds"))


@query("rate_budget_holds", _holds("O"))
def rate_budget_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = block_ops.encode_blocks(SERIES["O"](spark, sf_dir), RATED)
    rows = made.groupBy("series_id").agg(F.sum("sample_count").alias("samples"), (F.sum("record_bytes") + 64 + 12 + 16 * F.count("*")).alias("bytes"))
    return rows.select("series_id", F.col("samples").cast("long").alias("samples"), (F.col("bytes") <= F.floor(F.col("samples") * RATED.target_rate / 8)).alias("holds"))


@query("slice_equals_full", with_sql("E", f", n AS (SELECT count(*) AS n FROM s), r AS (SELECT * FROM (VALUES {', '.join(f'({a}, {c}, {d})' for a, _, c, d in _REQUESTS)}) t(request_id, start, count)) SELECT CAST(request_id AS BIGINT) AS request_id, CAST(greatest(0, least(count, n - start)) AS BIGINT) AS samples, TRUE AS holds FROM r, n WHERE n > start"))
def slice_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = block_ops.encode_blocks(events(spark, sf_dir), RATED)
    asked = spark.createDataFrame(_REQUESTS, "request_id long, series_id string, start long, count long")
    full = block_ops.decode_series(made).withColumnRenamed("value", "full")
    rows = block_ops.decode_slices(made, asked).join(full, ["series_id", "sample_idx"], "left")
    return rows.groupBy("request_id").agg(F.count("*").alias("samples"), F.bool_and(F.col("value").eqNullSafe(F.col("full"))).alias("holds"))


@query("frame_roundtrip", _holds("O"))
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = block_ops.encode_blocks(SERIES["O"](spark, sf_dir), RATED)
    back = block_ops.decode_series(block_ops.from_frames(block_ops.to_frames(made, RATED))).withColumnRenamed("value", "again")
    rows = block_ops.decode_series(made).join(back, ["series_id", "sample_idx"], "full")
    return rows.groupBy("series_id").agg(F.count("*").alias("samples"), F.bool_and(F.col("value").eqNullSafe(F.col("again"))).alias("holds"))


@query("stream_equals_batch", _holds("Et"))
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series through the stream encoder in uneven packets and the decoder in uneven fragments, against the whole series at once."""
    from ..sources.frame import StreamDecoder, StreamEncoder, compress, decompress

    ready(spark)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = t.sort_by("sample_idx").column("value").to_numpy()
        encoder, decoder, sent, got = StreamEncoder(absolute_error=0.01), StreamDecoder(), b"", []
        for a in range(0, len(x), 137):
            sent += encoder.feed(x[a : a + 137])
        sent += encoder.flush()
        for a in range(0, len(sent), 83):
            got.append(decoder.feed(sent[a : a + 83]))
        decoder.flush()
        same = np.array_equal(np.concatenate(got), decompress(compress(x, absolute_error=0.01)))
        return pa.table({"series_id": [key[0].as_py()], "samples": pa.array([len(x)], pa.int64()), "holds": [bool(same)]})

    return SERIES["Et"](spark, sf_dir).select("series_id", "sample_idx", "value").groupBy("series_id").applyInArrow(run, "series_id string, samples long, holds boolean")


@query("index_reconcile", with_sql("O", " SELECT series_id, count(DISTINCT block_no) AS blocks, CAST(0 AS BIGINT) AS faults FROM s GROUP BY series_id"))
def index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared index entries against observed records, by a full outer join, and the entries' own rules."""
    made = block_ops.encode_blocks(SERIES["O"](spark, sf_dir), RATED)
    declared = block_ops.record_offsets(made)
    seen = made.select("series_id", "block_no", F.lit(True).alias("seen"))
    rows = declared.join(seen, ["series_id", "block_no"], "full").join(block_ops.index_faults(declared).select("series_id", "block_no", F.lit(True).alias("wrong")), ["series_id", "block_no"], "left")
    return rows.groupBy("series_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("byte_offset").isNull() | F.col("seen").isNull() | F.col("wrong").isNotNull()).alias("faults"))


_BASE = f", {_quantile_sql(3)}, base AS (SELECT series_id, count(*) AS samples, {_PSNR} AS base_psnr FROM d GROUP BY series_id)"


@query("codec_comparison", with_sql("O", _BASE + " SELECT series_id, samples, base_psnr, TRUE AS above FROM base"))
def codec_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error-bounded codec beside the quantile baseline of three bits, joined on series: the baseline's PSNR, and whether the codec is above it."""
    own = quality_ops.quality(block_ops.roundtrip(SERIES["O"](spark, sf_dir), CodecConfig(absolute_error=100.0)), ["series_id"])
    values = table(spark, sf_dir, "orders").select(F.lit("O").alias("series_id"), F.col("o_totalprice").cast("float").alias("value"))  # no number is needed here
    base = quality_ops.quality(quality_ops.uniform_quantile(values, ["series_id"], 3), ["series_id"]).select("series_id", F.round("psnr_db", 5).alias("base_psnr"))
    return own.join(base, ["series_id"]).select("series_id", "samples", "base_psnr", (F.col("psnr_db") > F.col("base_psnr")).alias("above"))


# ---- sources --------------------------------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.concat(F.lit("reading,type="), F.col("event_type"), F.lit(' note="a b, c=1",value='), F.col("value").cast("string"), F.lit(" "), micros().cast("string")).alias("line"))


_POINTS = "SELECT event_id, epoch_us(ts) AS ts, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events"


@query("line_protocol_parse", _POINTS)
def line_protocol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.timeseries import read_lines

    return read_lines(_lines(spark, sf_dir), "value").select("event_id", "ts", F.col("value").cast("double").alias("value"))


@query("line_protocol_plain", _POINTS)
def line_protocol_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.timeseries import plain_point

    rows = _lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", ' note="a b, c=1",', " "))
    ts, value = plain_point(F.col("line"), "value")
    return rows.select("event_id", ts.alias("ts"), value.cast("double").alias("value"))


@query("chunk_roundtrip", with_sql("Et", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, ts, floor(CAST(value AS DOUBLE)) AS value FROM s"))
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in chunks and back; events of one type may share a time."""
    from ..sources.timeseries import decode_chunks, encode_chunks

    chunks = encode_chunks(whole("Et", spark, sf_dir), per_chunk=1000, repeats=True, absolute_error=0.25)
    return decode_chunks(chunks, repeats=True).select("series_id", (F.col("chunk_no") * 1000 + F.col("i")).alias("sample_idx"), "ts", F.rint("value").alias("value"))


@query("prometheus_points", with_sql("Eu", " SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, ts, CAST(value AS DOUBLE) AS value FROM s"))
def prometheus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.timeseries import prometheus_points as points

    rows = SERIES["Eu"](spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "ts", "value"))).alias("p"))
    return points(rows.select("series_id", F.col("p.ts").alias("timestamps"), F.col("p.value").alias("values"))).select("series_id", "sample_idx", "ts", F.col("value").cast("double").alias("value"))


@query("flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series compressed within an error bound: samples, blocks, bytes, bits per sample, ratio, PSNR and greatest error."""
    rows = SERIES["Et"](spark, sf_dir)
    made = block_ops.encode_blocks(rows, FINE)
    size = made.groupBy("series_id").agg(F.count("*").alias("blocks"), (F.sum("record_bytes") + 64).alias("wire_bytes"))
    back = block_ops.decode_series(made).withColumnRenamed("value", "decoded")
    report = quality_ops.quality(rows.join(back, ["series_id", "sample_idx"]), ["series_id"])
    return report.join(size, "series_id").select(
        "series_id",
        "samples",
        "blocks",
        "wire_bytes",
        (F.col("wire_bytes") * 8 / F.col("samples")).alias("bits_per_sample"),
        (F.col("samples") * 4 / F.col("wire_bytes")).alias("ratio"),
        "psnr_db",
        F.col("max_absolute_error").alias("linf"),
    )


@query("encode_rate")
def encode_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate-mode block table of the orders series."""
    return block_ops.encode_blocks(orders(spark, sf_dir), CodecConfig(target_rate=4.0)).drop("payload", "levels")


@query("encode_error")
def encode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error-mode block table of the events series."""
    return block_ops.encode_blocks(events(spark, sf_dir), FINE).drop("payload", "levels")


from . import formats  # noqa: E402, F401  adds its queries
