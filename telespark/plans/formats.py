"""More queries: formats, refusals, code books and reports. They add themselves to QUERIES and ORACLES when imported."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BLOCK, CodecConfig
from ..operators import blocks as block_ops
from ..operators import quality as quality_ops
from ..operators import stats
from ..session import ready
from .queries import _BOUNDS, _CELLS, _LEVELS, _REQUESTS, BLOCK_KEY, RATED, SERIES, WHOLE, _holds, orders, over, query, with_sql

#: Fixed value: what a CRC32-C gives over a string followed by its own checksum, lowest byte first.
RESIDUE = 0x48674BC7


def frames(which: str, spark: SparkSession, sf_dir: str, config: CodecConfig = RATED) -> DataFrame:
    return block_ops.to_frames(block_ops.encode_blocks(SERIES[which](spark, sf_dir), config), config)


# ---- checksums ------------------------------------------------------------------------------------------------------------------------------


@query("crc32c_residue", "SELECT event_id, TRUE AS holds FROM events")
def crc32c_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of strings of many lengths, by the one value that any string with its checksum behind it must give."""
    from ..functions.checksum import crc32c_many
    from ..session import table

    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column("s").to_pylist()]
            again = crc32c_many([x + struct.pack("<I", c) for x, c in zip(raw, crc32c_many(raw).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(again.astype(np.int64))], names=["event_id", "residue"])

    rows = table(spark, sf_dir, "events").select("event_id", F.expr("repeat(concat(event_type, cast(value as string)), cast(event_id % 90 as int))").alias("s"))
    kind = rows.schema["event_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"event_id {kind}, residue long").select("event_id", (F.col("residue") == RESIDUE).alias("holds"))


# ---- files and containers -------------------------------------------------------------------------------------------------------------------


@query("mseed_decode", with_sql("Et", " SELECT series_id AS path, CAST(sample_idx AS BIGINT) AS sample_idx, floor(CAST(value AS DOUBLE)) AS value FROM s"))
def mseed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole samples of each series as a chain of seismic records, read back."""
    from ..sources.seismic import decode_files, encode_mseed

    ready(spark)
    packets = over("Et", spark, sf_dir).groupBy("series_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.floor("value").cast("int").alias("v")))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_mseed(np.array(x, np.int32)) for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("series_id"), b.column("block_no"), pa.array(made, pa.binary())], names=["series_id", "block_no", "record"])

    records = packets.select("series_id", "block_no", F.col("p.v").alias("v")).mapInArrow(run, "series_id string, block_no long, record binary")
    files = records.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "record"))).alias("r"))
    content = F.aggregate(F.col("r.record"), F.lit(b""), lambda a, x: F.concat(a, x))
    return decode_files(files.select(F.col("series_id").alias("path"), content.alias("content")), "mseed")


@query("arrow_container_roundtrip", _holds("O"))
def arrow_container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in chunks of 1,500 samples through containers, beside each chunk by itself through a frame."""
    from ..sources.arrowbox import from_containers, to_containers
    from ..sources.frame import compress_many, decompress_many

    ready(spark)
    rows = orders(spark, sf_dir).withColumn("chunk_no", F.expr("cast(sample_idx div 1500 as int)"))
    chunks = rows.groupBy("series_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("p")).select("series_id", "chunk_no", F.col("p.value").alias("values"))
    back = from_containers(to_containers(chunks)).withColumnRenamed("values", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block_ops.BATCH):
                b = batch.slice(a, block_ops.BATCH)
                parts = block_ops.lists(b.column("values"), np.float32)
                alone = decompress_many(compress_many(parts, target_rate=3.0))
                same = [
                    start == 1500 * no and again.values is not None and bool(np.array_equal(x, again.values.to_numpy()))
                    for x, again, start, no in zip(alone, b.column("again"), b.column("start_sample").to_pylist(), b.column("chunk_no").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column("series_id"), pa.array(list(map(len, parts)), pa.int64()), pa.array(same)], names=["series_id", "n", "same"])

    both = chunks.join(back, ["series_id", "chunk_no"]).select("series_id", "chunk_no", "start_sample", "values", "again")
    made = both.mapInArrow(run, "series_id string, n long, same boolean")
    return made.groupBy("series_id").agg(F.sum("n").alias("samples"), F.bool_and("same").alias("holds"))


@query("indexed_view_slices", with_sql("O", f", n AS (SELECT count(*) AS n FROM s), r AS (SELECT * FROM (VALUES {', '.join(f'({a}, {c}, {d})' for a, _, c, d in _REQUESTS)}) t(request_id, start, count)) SELECT CAST(request_id AS BIGINT) AS request_id, CAST(CASE WHEN start + count <= n THEN count END AS BIGINT) AS samples, TRUE AS holds FROM r, n"))
def indexed_view_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of an indexed frame, equal to what a full decode has there; a range past the end is refused (samples is null)."""
    from ..sources.frame import IndexedView, decompress

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("frame").to_pylist():
                view, full = IndexedView(data), decompress(data)
                for request, _, start, count in _REQUESTS:
                    try:
                        got = view.slice(start, count)
                        n, same = len(got), np.array_equal(got, full[start : start + count])
                    except IndexError:
                        n, same = None, start + count > len(full)
                    yield pa.RecordBatch.from_arrays([pa.array([request], pa.int64()), pa.array([n], pa.int64()), pa.array([bool(same)])], names=["request_id", "samples", "holds"])

    return frames("O", spark, sf_dir).mapInArrow(run, "request_id long, samples long, holds boolean")


@query("frame_size_probe", _holds("Et"))
def frame_size_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each series' frame, told from the block table, against the frame that is written."""
    made = block_ops.encode_blocks(SERIES["Et"](spark, sf_dir), WHOLE)
    told = block_ops.frame_sizes(made, WHOLE)
    return told.join(block_ops.to_frames(made, WHOLE), "series_id").select("series_id", "samples", (F.col("frame_bytes") == F.octet_length("frame")).alias("holds"))


# ---- refusals -------------------------------------------------------------------------------------------------------------------------------

#: What is done to a frame: a name, and a function of its bytes. Each must be refused.
DAMAGE = {
    "magic": lambda d: b"\0" + d[1:],
    "future version": lambda d: d[:4] + struct.pack("<H", 7) + d[6:],
    "indexed frame of the old version": lambda d: d[:4] + struct.pack("<H", 5) + d[6:],
    "reserved header byte": lambda d: d[:30] + b"\1" + d[31:],
    "unknown flag": lambda d: d[:20] + struct.pack("<I", 8) + d[24:],
    "block count": lambda d: d[:16] + struct.pack("<I", 1 << 20) + d[20:],
    "sample count": lambda d: d[:8] + struct.pack("<Q", struct.unpack_from("<Q", d, 8)[0] + BLOCK) + d[16:],
    "cut header": lambda d: d[:63],
    "cut record": lambda d: d[:100],
    "body byte": lambda d: d[:90] + bytes([d[90] ^ 1]) + d[91:],
    "payload byte": lambda d: d[:200] + bytes([d[200] ^ 255]) + d[201:],
    "record size": lambda d: d[:64] + struct.pack("<I", 1 << 25) + d[68:],
    "index entry": lambda d: d[:-12] + bytes([d[-12] ^ 4]) + d[-11:],
    "index checksum": lambda d: d[:-1] + bytes([d[-1] ^ 1]),
    "bytes behind the end": lambda d: d + bytes(64),
    "empty": lambda d: b"",
}


@query("frame_refusals", with_sql("Et", f" SELECT damage, count(DISTINCT series_id) AS frames, count(DISTINCT series_id) AS refused FROM s, (SELECT unnest({list(DAMAGE)}) AS damage) GROUP BY damage"))
def frame_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames damaged in one place each: every one is refused with an error of the format, none decodes or crashes."""
    from ..errors import CorruptedStream, DeprecatedWireFormat, UnsupportedWireFormat
    from ..sources.frame import decompress

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("frame").to_pylist():
                refused = []
                for harm in DAMAGE.values():
                    try:
                        decompress(harm(data))
                        refused.append(False)
                    except (CorruptedStream, DeprecatedWireFormat, UnsupportedWireFormat):
                        refused.append(True)
                yield pa.RecordBatch.from_arrays([pa.array(list(DAMAGE)), pa.array(refused)], names=["damage", "refused"])

    made = frames("Et", spark, sf_dir, WHOLE).mapInArrow(run, "damage string, refused boolean")
    return made.groupBy("damage").agg(F.count("*").alias("frames"), F.count_if("refused").alias("refused"))


@query("slice_range_faults", with_sql("Eu", " SELECT series_id, count(*) AS samples FROM s GROUP BY series_id HAVING count(*) < 66"))
def slice_range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that a slice of samples 20 to 65 would leave."""
    return block_ops.slice_faults(block_ops.encode_blocks(SERIES["Eu"](spark, sf_dir), CodecConfig(absolute_error=0.25)), 20, 46)


@query("non_finite_refused", "SELECT CAST(event_id AS BIGINT) AS event_id, event_id % 7 = 0 AS refused FROM events")
def non_finite_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values an encoder refuses: null, NaN and infinite ones, put in place of every seventh."""
    from ..operators.series import not_finite
    from ..session import table

    bad = F.when(F.col("event_id") % 21 == 0, F.lit(None)).when(F.col("event_id") % 21 == 7, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.when(F.col("event_id") % 7 == 0, bad).otherwise(F.col("value").cast("double")).alias("v"))
    return rows.select("event_id", not_finite(F.col("v")).alias("refused"))


# ---- code books -------------------------------------------------------------------------------------------------------------------------------


@query("quantize_lower_ties", with_sql("O", f" SELECT series_id, CAST(sample_idx AS BIGINT) AS sample_idx, CAST(len(list_filter(CAST({_BOUNDS} AS DOUBLE[]), lambda b: b < floor(CAST(value AS DOUBLE) / 5000) * 5000)) AS INTEGER) AS cell FROM s"))
def quantize_lower_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rounded values, a quarter of which lie on a boundary, where such a value belongs to the lower cell."""
    value = F.floor(F.col("value").cast("double") / 5000) * 5000
    return over("O", spark, sf_dir).select("series_id", "sample_idx", stats.cell_of(value.cast("double"), F.array(*map(F.lit, _BOUNDS)), lower_ties=True).alias("cell"))


def _lloyd_sql(rounds: int) -> str:
    """Levels after so many rounds, by repeated means of the cells between the levels' middles."""
    out = f", l0 AS (SELECT CAST({_LEVELS} AS DOUBLE[]) AS levels)"
    for i in range(rounds):
        out += f""", b{i} AS (SELECT levels, list_transform(range(1, {len(_LEVELS)}), lambda k: (levels[k] + levels[k + 1]) / 2) AS bounds FROM l{i}),
            c{i} AS (SELECT CAST(len(list_filter(bounds, lambda b: b <= CAST(value AS DOUBLE))) AS INTEGER) AS cell, avg(CAST(value AS DOUBLE)) AS level FROM s, b{i} GROUP BY 1),
            l{i + 1} AS (SELECT list(coalesce(c{i}.level, b{i}.levels[k + 1]) ORDER BY k) AS levels FROM range({len(_LEVELS)}) t(k) CROSS JOIN b{i} LEFT JOIN c{i} ON c{i}.cell = k)"""
    return out


@query("empirical_lloyd", with_sql("O", _lloyd_sql(3) + f" SELECT CAST(k AS INTEGER) AS cell, round(levels[k + 1], 3) AS level FROM l3, range({len(_LEVELS)}) t(k)"))
def empirical_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels fitted to all samples, three rounds."""
    levels = quality_ops.lloyd_levels(orders(spark, sf_dir), _LEVELS, 3)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(levels)], "cell int, level double").select("cell", F.round("level", 3).alias("level"))


_TALL = ", tall AS (SELECT series_id, CAST(CASE WHEN sample_idx % 5000 < 300 THEN sample_idx % 5000 ELSE 0 END AS BIGINT) % 256 AS symbol FROM s), hist AS (SELECT series_id, CAST(0 AS BIGINT) AS block_no, symbol, count(*) AS n FROM tall GROUP BY ALL)"


def frequencies_sql(hist: str) -> str:
    """Frequencies that sum to 4096: remainders first; what the minimum of one takes too much comes off the largest, one at a time."""
    return hist + """, ex AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, block_no) * 4096 AS exact FROM hist), fl AS (SELECT *, greatest(1, CAST(floor(exact) AS BIGINT)) AS f0 FROM ex),
    rk AS (SELECT *, CAST(4096 - sum(f0) OVER (PARTITION BY series_id, block_no) AS BIGINT) AS spare, row_number() OVER (PARTITION BY series_id, block_no ORDER BY exact - floor(exact) DESC, symbol) AS k FROM fl),
    steps AS (SELECT series_id, block_no, symbol, row_number() OVER (PARTITION BY series_id, block_no ORDER BY f0 - j DESC, symbol) AS turn, spare FROM (SELECT *, unnest(range(CASE WHEN spare < 0 THEN least(f0 - 1, -spare) ELSE 0 END)) AS j FROM rk)),
    taken AS (SELECT series_id, block_no, symbol, count(*) AS off FROM steps WHERE turn <= -spare GROUP BY ALL),
    fr AS (SELECT series_id, block_no, symbol, n, CAST(f0 + CASE WHEN k <= spare THEN 1 ELSE 0 END - coalesce(off, 0) AS BIGINT) AS freq FROM rk LEFT JOIN taken USING (series_id, block_no, symbol))"""


@query("freq_normalize_tall", with_sql("O", frequencies_sql(_TALL) + " SELECT series_id, symbol, freq, CAST(sum(freq) OVER (PARTITION BY series_id ORDER BY symbol) - freq AS BIGINT) AS cum, CAST(sum(freq) OVER (PARTITION BY series_id) AS BIGINT) AS total FROM fr"))
def freq_normalize_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of a whole series, one symbol of which is very common: the minimum of one takes more than there is to share."""
    part = F.col("sample_idx") % 5000
    rows = orders(spark, sf_dir).select("series_id", F.lit(0).cast("long").alias("block_no"), (F.when(part < 300, part).otherwise(0) % 256).cast("long").alias("symbol"))
    made = stats.normalised_frequencies(stats.histogram(rows, BLOCK_KEY), BLOCK_KEY)
    return made.select("series_id", "symbol", F.col("freq").cast("long").alias("freq"), F.col("cum").cast("long").alias("cum")).withColumn("total", F.lit(4096).cast("long"))


# ---- reports ---------------------------------------------------------------------------------------------------------------------------------


@query("rate_report", " UNION ALL ".join(f"SELECT * FROM ({with_sql('Et', f' SELECT series_id, CAST({bits} AS INTEGER) AS rate, count(*) AS samples, CAST(ceil(count(*) * {bits} / 8.0) + {4 * 2**bits} AS BIGINT) AS bytes, round((ceil(count(*) * {bits} / 8.0) + {4 * 2**bits}) * 8 / count(*), 6) AS bits_per_sample, round(count(*) * 4 / (ceil(count(*) * {bits} / 8.0) + {4 * 2**bits}), 6) AS ratio FROM s GROUP BY series_id')})" for bits in (2, 3, 4)))
def rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, bits per sample and ratio of the quantile baseline, by series and rate."""
    counts = SERIES["Et"](spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("samples"))
    rows = counts.withColumn("rate", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    size = F.ceil(F.col("samples") * F.col("rate") / 8.0) + 4 * F.call_function("shiftleft", F.lit(1), F.col("rate"))
    return quality_ops.sizes(rows.withColumn("bytes", size.cast("long"))).select("series_id", "rate", "samples", "bytes", F.round("bits_per_sample", 6).alias("bits_per_sample"), F.round("ratio", 6).alias("ratio"))


@query("peak_gate", with_sql("Et", " SELECT series_id, round(max(abs(CAST(value AS DOUBLE))) / 60 / 9.80665, 6) AS peak_g FROM s GROUP BY series_id HAVING max(abs(CAST(value AS DOUBLE))) / 60 / 9.80665 > 0.5"))
def peak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose peak acceleration is over half of gravity."""
    rows = SERIES["Et"](spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return quality_ops.peak_gate(rows, ["series_id"], 60.0).select("series_id", F.round("peak_g", 6).alias("peak_g"))
