import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.config import CodecConfig
from telespark.operators import blocks, quality, series, stats
from telespark.sources.synthetic import KINDS, trace


@pytest.mark.parametrize("kind", KINDS)
def test_traces_are_the_same_on_any_partitioning(spark, kind):
    a = trace(spark, kind, 5000).orderBy("sample_idx").toPandas()
    b = trace(spark, kind, 5000).repartition(7).orderBy("sample_idx").toPandas()
    assert len(a) == 5000 and np.isfinite(a["value"]).all()
    assert np.allclose(a["value"], b["value"], atol=1e-6)


def test_traces_through_the_codec(spark):
    x = trace(spark, "resonant", 20_000).union(trace(spark, "sparse-shock", 20_000)).cache()
    made = blocks.encode_blocks(x, CodecConfig(absolute_error=0.01))
    report = quality.quality(x.join(blocks.decode_series(made).withColumnRenamed("value", "decoded"), ["series_id", "sample_idx"]), ["series_id"])
    assert all(r.max_absolute_error <= 0.01 * 1.0001 for r in report.collect())
    rated = blocks.encode_blocks(x, CodecConfig(target_rate=3.0))
    assert blocks.rate_faults(rated, CodecConfig(target_rate=3.0)).count() == 0


def test_impulsive_blocks_are_found(spark):
    x = series.with_blocks(trace(spark, "sparse-shock", 3 * 2048).withColumn("value", F.when(F.col("sample_idx") == 5000, 9.0).otherwise(F.col("value")).cast("float")))
    found = stats.impulsive(stats.ged_estimate(stats.ged_moments(stats.open_loop_residuals(x, stats.predictor_select(x))))).first()
    assert found["blocks"] == 3 and 2 in found["triggered_blocks"]
