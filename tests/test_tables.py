"""Operators over tables: queries against their SQL twins, the block table's contracts, files and streams."""

import glob
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.config import BLOCK, CodecConfig
from telespark.operators import blocks as B
from telespark.operators import series as S
from telespark.operators import stats
from telespark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name == "slice_fetch"  # the smallest table ends before its slice
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def samples(spark, n=3 * BLOCK + 700, series=("a", "b")):
    i = np.arange(n)
    rows = [(s, int(k), float(v)) for s, f in zip(series, (0.017, 0.2), strict=False) for k, v in zip(i, np.sin(f * i), strict=True)]
    return spark.createDataFrame(rows, "series_id string, sample_idx long, value float").repartition(3)


@pytest.mark.parametrize("config", [CodecConfig(3.0, enable_index=True), CodecConfig(absolute_error=0.001)])
def test_block_table_equals_frames(spark, config):
    from telespark.sources.frame import compress, decompress

    x = samples(spark)
    made = B.encode_blocks(x, config).cache()
    frames = {r.series_id: bytes(r.frame) for r in B.to_frames(made, config).collect()}
    got = B.decode_series(made).orderBy("series_id", "sample_idx").toPandas()
    for s, rows in x.orderBy("sample_idx").toPandas().groupby("series_id"):
        alone = compress(rows["value"].to_numpy(), config.target_rate, config.absolute_error, enable_index=config.enable_index)
        assert frames[s] == alone
        assert decompress(alone).tobytes() == got[got.series_id == s]["value"].to_numpy(np.float32).tobytes()
    assert B.rate_faults(made, config).count() == 0 or config.error_bounded
    assert B.index_faults(B.record_offsets(made)).count() == 0
    assert B.invalid_blocks(made).count() == 0


def test_slice_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "blocks")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    B.encode_blocks(samples(spark), CodecConfig(absolute_error=0.01)).write.parquet(path)
    part = B.decode_slice(spark.read.parquet(path), 2000, 200, "a")
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(block_no,0)" in plan and "LessThanOrEqual(block_no,1)" in plan
    assert [r.sample_idx for r in part.orderBy("sample_idx").collect()] == list(range(2000, 2200))
    assert B.decode_slice(spark.read.parquet(path), 5, 0).count() == 0
    with pytest.raises(IndexError):
        B.decode_slice(spark.read.parquet(path), -1, 5)


def test_broken_blocks_are_told(spark):
    made = B.encode_blocks(samples(spark), CodecConfig(absolute_error=0.01))
    broken = made.withColumn("payload", F.when((F.col("series_id") == "a") & (F.col("block_no") == 1), F.expr("substr(payload, 2)")).otherwise(F.col("payload")))
    assert [(r.series_id, r.block_no, r.error_class) for r in B.invalid_blocks(broken).collect()] == [("a", 1, "CorruptedStream")]
    with pytest.raises(Exception, match="CorruptedStream"):
        B.decode_series(broken).count()


def test_index_rules(spark):
    rows = [("a", 0, 64, 0, BLOCK), ("a", 1, 128, BLOCK, 10), ("b", 0, 64, 0, BLOCK), ("b", 1, 100, BLOCK, 10), ("c", 0, 64, 0, 5), ("c", 1, 128, 5, 5), ("d", 0, 128, 0, 5)]
    entries = spark.createDataFrame(rows, "series_id string, block_no long, byte_offset long, start_sample long, sample_count long")
    assert sorted((r.series_id, r.block_no) for r in B.index_faults(entries).collect()) == [("b", 1), ("c", 0), ("d", 0)]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_bad_values_fail(spark, bad):
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 1, bad)], "series_id string, sample_idx long, value float")
    with pytest.raises(Exception, match="non-finite"):
        B.encode_blocks(x, CodecConfig(absolute_error=0.1)).count()


def test_numbering_with_ties_and_an_empty_table(spark):
    x = spark.createDataFrame([("a", 5, 1.0, 2), ("a", 5, 2.0, 1), ("a", 1, 3.0, 9), ("b", 5, 4.0, 0)], "k string, o long, v double, t int")
    rows = S.samples(x, F.col("k"), F.col("o"), F.col("v"), F.col("t")).collect()
    assert sorted((r.series_id, r.sample_idx, r.value) for r in rows) == [("a", 0, 3.0), ("a", 1, 2.0), ("a", 2, 1.0), ("b", 0, 4.0)]
    assert S.samples(x.limit(0), F.col("k"), F.col("o"), F.col("v")).count() == 0


def test_flat_blocks_have_shape_two(spark):
    x = S.with_blocks(spark.createDataFrame([("a", i, 7.0) for i in range(100)], "series_id string, sample_idx long, value float"))
    modes = stats.predictor_select(x)
    made = stats.ged_estimate(stats.ged_moments(stats.open_loop_residuals(x.where("pos > 0").withColumn("pos", F.col("pos") - 1), modes))).first()
    assert modes.first()["mode"] == 0 and made["n"] == 99


def test_files(spark, tmp_path):
    from telespark.sources.seismic import read_files

    x = np.linspace(0, 1, 70_000).astype("<f4")
    np.save(tmp_path / "x.npy", x)
    x.tofile(tmp_path / "x.f32")
    for kind in ("npy", "f32"):
        got = read_files(spark, str(tmp_path / f"x.{kind}"), kind).orderBy("sample_idx").toPandas()
        assert got["value"].to_numpy(np.float32).tobytes() == x.tobytes()


def test_lines_with_errors(spark):
    from telespark.sources.timeseries import read_lines

    rows = read_lines(spark.createDataFrame([(1, "m v=1 5"), (2, "bad"), (3, ""), (4, None)], "n int, line string")).collect()
    assert [(r.n, r.ts, r.value, r.error is None) for r in rows] == [(1, 5, 1.0, True), (2, None, None, False)]


def test_streams(spark, tmp_path):
    """Packets through the stream encoder, its frames through the stream decoder; the samples of a batch come out."""
    from telespark.sources.frame import compress, decompress
    from telespark.streaming import decode_stream, encode_stream

    x = np.sin(0.01 * np.arange(5000)).astype(np.float32)
    packets = [("s", i, [float(v) for v in x[a : a + 700]], a + 700 >= len(x)) for i, a in enumerate(range(0, len(x), 700))]
    schema = "stream_id string, seq long, values array<float>, last boolean"
    for part in range(2):
        spark.createDataFrame(packets[part * 4 : part * 4 + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{part}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = encode_stream(source, CodecConfig(absolute_error=0.01)).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert out.exception() is None
    frames = spark.table("frames").orderBy("seq").collect()
    assert [r.seq for r in frames] == [0, 1, 2]
    want = decompress(compress(x, absolute_error=0.01)).tobytes()
    assert np.concatenate([decompress(bytes(r.frame)) for r in frames]).tobytes() == want
    sent = b"".join(bytes(r.frame) for r in frames)
    spark.createDataFrame([("s", i, bytearray(sent[a : a + 777])) for i, a in enumerate(range(0, len(sent), 777))], "stream_id string, seq long, chunk binary").coalesce(1).write.parquet(str(tmp_path / "frag"))
    back = decode_stream(spark.readStream.schema("stream_id string, seq long, chunk binary").parquet(str(tmp_path / "frag")))
    out = back.writeStream.format("memory").queryName("samples").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert out.exception() is None
    got = [v for r in spark.table("samples").orderBy("seq").collect() for v in r["values"]]
    assert np.array(got, np.float32).tobytes() == want


def test_results_and_manifest(spark, tmp_path):
    from telespark.operators import quality

    rows = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "series_id string, sample_idx long, value float")
    report = quality.quality(rows.withColumn("decoded", F.col("value")), ["series_id"])
    assert report.first()["psnr_db"] == float("inf")
    for kind in ("json", "csv"):
        quality.write_results(report, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).first()["samples"] == 100 and '"psnr_db":null' in next((tmp_path / "json").glob("part-*")).read_text()
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["psnr_db"] is None
    made = quality.manifest(rows, "here", "g", False).first()
    assert (made["samples"], made["least"], made["greatest"], made["bytes"], made["source"]) == (100, 0.0, 99.0, 400, "here")


def test_lags_and_sums_across_blocks(spark):
    r = np.random.default_rng(1)
    n = 2 * BLOCK + 3
    for size in (1, 2, BLOCK, BLOCK + 1, n):
        x = r.integers(-9, 9, size).tolist()
        rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "series_id string, sample_idx long, v long").repartition(3)
        got = sorted(stats.lagged(rows, "v", 2).select("sample_idx", "v_1", "v_2").collect())
        assert [(g.v_1, g.v_2) for g in got] == [(x[i - 1] if i else None, x[i - 2] if i > 1 else None) for i in range(size)]
        sums = sorted(stats.running_sum(rows, "v", "total").select("sample_idx", "total").collect())
        assert [s.total for s in sums] == np.cumsum(x).tolist()


def test_quantiles_without_a_task_of_all_values(spark):
    from telespark.operators import quality

    x = np.random.default_rng(5).normal(size=3000).tolist()
    cases = {"many": x, "ties": [float(int(3 * v)) for v in x], "one": [2.5], "two": [1.0, None, 4.0], "null": [None, None], "ends": [-0.0, 0.0, float("inf"), float("nan"), 7.0]}
    rows = spark.createDataFrame([(k, v) for k, c in cases.items() for v in c], "series_id string, value double").repartition(5)
    for bits in (2, 3, 4):
        at = [(i + 0.5) / (1 << bits) for i in range(1 << bits)]
        want = {r[0]: r[1] for r in rows.groupBy("series_id").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("levels")).collect()}
        got = {r[0]: r[1] for r in quality.quantiles(rows, ["series_id"], at).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (got[k] is None) == (v is None) and (v is None or np.array_equal(got[k], v, equal_nan=True)), k
    made = quality.uniform_quantile(rows, ["series_id"], 3)
    assert made.count() == rows.count()
    assert "percentile(" not in made._jdf.queryExecution().toString()  # it keeps all different values of a series in one task


def test_ranges_by_halving(spark):
    cuts = [-1.0, 0.0, 2.5, 7.0, 9.0]
    x = [None, float("-inf"), -1.0, -0.5, 0.0, 2.5, 8.0, 9.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in x], "x double").withColumn("n", S.range_of(F.col("x"), cuts)).collect()
    assert [r.n for r in rows] == [0, 0, 1, 1, 2, 3, 4, 5, 5, 5]


def test_a_container_is_coded_and_decoded_in_many_tasks(spark):
    from telespark.sources import arrowbox, frame

    rng = np.random.default_rng(8)
    parts = [rng.normal(size=n).astype(np.float32) for n in (2048, 1500, 0, 1700, 6144, 3600, 1500)]
    some = [p for p in parts if len(p)]
    for settings in ({"target_rate": 3.0}, {"absolute_error": 0.01, "enable_index": True}):
        assert frame.compress_many(some, **settings) == [frame.compress(p, **settings) for p in some]
    assert [x.tobytes() for x in frame.decompress_many([frame.compress(p) for p in some])] == [frame.decompress(frame.compress(p)).tobytes() for p in some]
    rows = spark.createDataFrame([("a", i, p.tolist()) for i, p in enumerate(parts)], "series_id string, chunk_no int, values array<float>").repartition(4)
    boxes = arrowbox.to_containers(rows, 3.0)
    assert bytes(boxes.first().container) == arrowbox.pack(parts, 3.0)
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("MapInArrow") > plan.index("Aggregate")  # chunks are coded before a series comes together
    back = arrowbox.from_containers(boxes).withColumn("task", F.spark_partition_id()).orderBy("chunk_no").collect()
    assert len({r.task for r in back}) > 1
    for r, want, start in zip(back, arrowbox.unpack(arrowbox.pack(parts, 3.0)), np.cumsum([0, *map(len, parts)]), strict=False):
        assert np.array(r["values"], np.float32).tobytes() == want.tobytes() and r.start_sample == start
    with pytest.raises(Exception, match="nulls"):
        arrowbox.to_containers(spark.createDataFrame([("a", 0, [1.0, None])], "series_id string, chunk_no int, values array<float>")).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["codec_comparison", "rd_summary", "uniform_quantile_codec"])
def test_quantile_baselines_hold_no_series_in_a_task(spark, name):
    assert "percentile(" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_blocks_are_coded_and_decoded_in_one_task(spark, monkeypatch):
    from telespark.operators import quality

    rng = np.random.default_rng(11)
    ends = {"a": 3 * BLOCK + 7, "b": 1, "c": 2 * BLOCK, None: BLOCK + 1}
    made = [(k, i, float(v)) for k, n in ends.items() for i, v in enumerate(np.cumsum(rng.normal(size=n)))]
    gaps = [("d", i, float(i % 17)) for i in (0, 5, BLOCK - 1, 4 * BLOCK + 3, 4 * BLOCK + 9, 9 * BLOCK)]
    rows = spark.createDataFrame(made + gaps, "series_id string, sample_idx long, value float").repartition(5)
    value = {(k, i): np.float32(v) for k, i, v in made + gaps}
    config = CodecConfig(absolute_error=0.01)
    for paired, records in ((128, 10000), (2, 700), (1, 1)):
        monkeypatch.setattr(B, "PAIRED", paired)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            some = rows if records > 1 else rows.where("series_id in ('b', 'd')")
            got = B.roundtrip(some, config)
            want = B.decode_blocks(B.encode_blocks(some, config)).select("series_id", "block_no", F.explode("values").alias("decoded"))
            assert sorted((r.series_id or "", r.decoded) for r in got.collect()) == sorted((r.series_id or "", r.decoded) for r in want.collect())
            assert sorted((r.series_id or "", r.value) for r in got.collect()) == sorted((k or "", v) for (k, _), v in value.items() if records > 1 or k in ("b", "d"))
            assert max(r.max_absolute_error for r in quality.quality(got, ["series_id"]).collect()) <= config.absolute_error * 1.001
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert B.roundtrip(rows.where("false"), CodecConfig(absolute_error=1.0)).collect() == []
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="non-finite"):
            B.roundtrip(spark.createDataFrame([("a", 0, 1.0), ("a", 1, bad)], "series_id string, sample_idx long, value float"), CodecConfig(absolute_error=1.0)).collect()


def test_quantiles_count_values_only_where_ranks_lie(spark):
    from telespark.operators import quality

    rows = spark.range(20000).selectExpr("'a' AS series_id", "CAST(id AS DOUBLE) AS value")
    levels = quality.quantiles(rows, ["series_id"], [0.25, 0.75])
    assert levels.first().levels == [4999.75, 14999.25]
    kept = re.search(r"_range#\d+ IN \(([\d,]+)\)|CASE WHEN .* IN \(([\d,]+)\)", levels._jdf.queryExecution().optimizedPlan().toString())
    assert kept and len((kept[1] or kept[2]).split(",")) <= 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_comparison_joins_no_samples(spark):
    """Neither do samples meet their decoded ones in a join, nor does an aggregate gather blocks, nor does the baseline number rows."""
    plan = QUERIES["codec_comparison"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(pos" not in plan and "collect_list(named_struct(pos" not in plan
    assert not re.search(r"Join .*sample_idx", plan) and plan.count("row_number()") == 1


def test_the_first_query_of_a_session(spark, tmp_path):
    """In a process of its own: there the table's columns get Spark's lowest expression ids."""
    spark.range(5000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00.25' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id", "if(id % 2 = 0, 'a', 'b') AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from telespark.plans.queries import QUERIES
print([tuple(r) for r in QUERIES["peak_acceleration"](spark, {str(tmp_path)!r}).orderBy("series_id").collect()])
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_CONNECT"))} | {"PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert eval(run.stdout) == [("a", round(4998 / 213979.6422 / 9.80665, 10)), ("b", round(4999 / 213979.6422 / 9.80665, 10))]


def test_chunks_with_repeated_times(spark, tmp_path):
    from telespark.errors import CorruptedStream
    from telespark.sources import timeseries as T

    ts = np.repeat(1_000_000 * np.arange(1, 1300), 3)[: 2 * BLOCK - 500]
    v = np.round(50 * np.sin(0.1 * np.arange(len(ts)))).astype(np.float32)
    data = T.write_chunk(ts, v, repeats=True, absolute_error=0.25)
    back, got = T.read_chunk(data, repeats=True)
    assert (back == ts).all() and (np.rint(got) == v).all()
    with pytest.raises(ValueError):
        T.write_chunk(ts, v, absolute_error=0.25)
    with pytest.raises(CorruptedStream):
        T.read_chunk(data)
    with pytest.raises(ValueError):
        T.write_chunk(ts[::-1], v, repeats=True, absolute_error=0.25)
    parts = [(np.sort(ts[a:e]), v[a:e]) for a, e in ((0, 1), (1, 900), (900, 3596))]
    assert T.write_chunks(parts, repeats=True, absolute_error=0.25) == [T.write_chunk(*p, repeats=True, absolute_error=0.25) for p in parts]

    rows = [(s, i, int(t), float(x)) for s in ("a", "b", None) for i, (t, x) in enumerate(zip(ts, v, strict=True))]
    points = spark.createDataFrame(rows, "series_id string, sample_idx long, ts long, value float").repartition(3)
    chunks = T.encode_chunks(points, per_chunk=700, repeats=True, absolute_error=0.25).cache()
    assert sorted((r.series_id or "", r.chunk_no, r.first_ts, r.n) for r in chunks.collect()) == [(s, k, int(ts[700 * k]), min(700, len(ts) - 700 * k)) for s in ("", "a", "b") for k in range(6)]
    assert sorted((r.series_id or "", r.chunk_no * 700 + r.i, r.ts, round(r.value)) for r in T.decode_chunks(chunks, repeats=True).collect()) == sorted((s or "", i, t, x) for s, i, t, x in rows)

    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id div 3)"
    spark.range(4000).selectExpr("id AS event_id", f"{at} AS ts", "id % 7 AS user_id", "if(id % 2 = 0, 'a', 'b') AS event_type", "CAST(id AS DOUBLE) / 8 AS value").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["chunk_roundtrip"](spark, str(tmp_path)).orderBy("series_id", "sample_idx").collect()
    start = int(np.datetime64("2024-01-01", "us").astype(np.int64))
    assert [tuple(r) for r in got] == [(s, k, start + i // 3 * 1_000_000, float(i // 8)) for s, f in (("a", 0), ("b", 1)) for k, i in enumerate(range(f, 4000, 2))]
