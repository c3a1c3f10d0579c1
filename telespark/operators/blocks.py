"""Block tables: the engine's native form of compressed series, one row per (series_id, block_no).

Statistics, index and slices are column functions over this table; a slice's block range reaches the Parquet scan as a pushed filter, and payloads of
other blocks are never read. Encoding costs one shuffle by (series_id, block_no), decoding none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLOCK, HEADER_BYTES, CodecConfig
from ..errors import CorruptedStream, RateBudgetExceeded
from ..functions.checksum import crc32c_many
from ..session import ready
from . import codec
from .series import block_arrays, checked, series_of_blocks, with_blocks

#: Blocks that one numpy batch holds.
BATCH = codec.SIDE
#: The same where blocks are coded and decoded in one worker: as fast, and a worker takes 80 MB less.
PAIRED = 128
TABLE = "series_id string, block_no long, start_sample long, sample_count int, quant_mode tinyint, predictor tinyint, harmonic float, scale_or_alpha float, beta float, levels array<float>, payload binary, body_bytes int, record_bytes int, crc32c long"
_NAMES = [f.split()[0] for f in TABLE.split(", ")]


def lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows(keys: list[pa.Array], blocks: list[codec.Block]) -> pa.RecordBatch:
    bodies = [b.body() for b in blocks]
    crc = crc32c_many(bodies)
    column = lambda f, t: pa.array([f(b) for b in blocks], t)
    return pa.RecordBatch.from_arrays(
        [
            *keys,
            column(lambda b: b.count, pa.int32()),
            column(lambda b: b.quant_mode, pa.int8()),
            column(lambda b: b.predictor, pa.int8()),
            column(lambda b: b.harmonic, pa.float32()),
            column(lambda b: b.scale, pa.float32()),
            column(lambda b: b.beta, pa.float32()),
            pa.array([b.levels for b in blocks], pa.list_(pa.float32())),
            column(lambda b: b.payload, pa.binary()),
            pa.array(list(map(len, bodies)), pa.int32()),
            column(lambda b: b.record_bytes, pa.int32()),
            pa.array(crc.astype(np.int64)),
        ],
        names=_NAMES,
    )


def _encoder(config: CodecConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                x, count = codec.as_rows(lists(part.column("values"), np.float32))
                codec.check_samples(x)
                if config.error_bounded:
                    made = codec.encode_error(x, count, config.absolute_error)
                else:
                    budget = [codec.record_budget(int(b), int(c), config) for b, c in zip(part.column("block_no").to_numpy(), count, strict=True)]
                    made = codec.encode_rate(x, count, config, np.array(budget))
                yield _rows([part.column(c) for c in _NAMES[:3]], made)

    return run


def encode_blocks(samples: DataFrame, config: CodecConfig) -> DataFrame:
    """The block table of samples (series_id, sample_idx, value). Every block's budget is known from its number, so each is coded once, by itself."""
    ready(samples.sparkSession)
    return block_arrays(samples).mapInArrow(_encoder(config), TABLE)


def _block(r: dict) -> codec.Block:
    return codec.Block(r["sample_count"], r["quant_mode"], r["predictor"], r["harmonic"], r["scale_or_alpha"], r["beta"], np.array(r["levels"], np.float32), r["payload"])


DECODED = "series_id string, block_no long, start_sample long, values array<float>"
QUARANTINE = "series_id string, block_no long, error_class string, message string"


def _checked(part: pa.RecordBatch) -> list[codec.Block]:
    rows = [_block(r) for r in part.select(["sample_count", "quant_mode", "predictor", "harmonic", "scale_or_alpha", "beta", "levels", "payload"]).to_pylist()]
    bodies = [b.body() for b in rows]
    if (crc32c_many(bodies).astype(np.int64) != part.column("crc32c").to_numpy()).any():
        raise CorruptedStream("block checksum mismatch")
    return [codec.read_body(b) for b in bodies]


def _decoded(part: pa.RecordBatch) -> pa.Array:
    return pa.array(codec.decode_blocks(_checked(part)), pa.list_(pa.float32()))


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(series_id, block_no, start_sample, values); checksums and every field are checked first."""
    ready(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _NAMES[:3]), _decoded(part)], names=["series_id", "block_no", "start_sample", "values"])

    return blocks.select(*_NAMES).mapInArrow(run, DECODED)


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """At most so many blocks at once, with their values, of sorted rows (series_id, block_no, value) that batches cut anywhere."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < most * BLOCK:
                continue
        if not any(b.num_rows for b in held):
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        name = rows.column("series_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        number = rows.column("block_no").to_numpy()
        starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (number[1:] != number[:-1])))
        ends = np.append(starts[1:], len(name))
        if batch is not None:  # the last block may go on
            held = rows.slice(starts[-1]).to_batches()
            starts, ends = starts[:-1], ends[:-1]
        for a in range(0, len(starts), most):
            some, first = starts[a : a + most], starts[a]
            flat = rows.column("value").slice(first, ends[a : a + most][-1] - first).combine_chunks()
            offsets = pa.array(np.append(some, ends[a : a + most][-1]) - first, pa.int32())
            heads = rows.select(["series_id", "block_no"]).take(pa.array(some)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in heads.columns), pa.array(number[some] * BLOCK), pa.ListArray.from_arrays(offsets, flat)],
                names=["series_id", "block_no", "start_sample", "values"],
            )


def roundtrip(samples: DataFrame, config: CodecConfig) -> DataFrame:
    """(series_id, value, decoded): each sample beside what decode_blocks() reads from its block's record.

    A block is coded and decoded in one task, where its samples still are: no join brings all samples and all decoded ones together. Samples
    reach a task sorted, as rows; only in Python are they blocks, so the JVM holds none as objects.
    """
    ready(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(config)
        for part in _whole(batches, PAIRED):
            for made in encode(iter([part])):
                names, values = part.column("series_id"), part.column("values")
                times = pa.array(np.repeat(np.arange(part.num_rows), values.value_lengths().to_numpy()))
                yield pa.RecordBatch.from_arrays([names.take(times), values.flatten(), _decoded(made).flatten()], names=["series_id", "value", "decoded"])

    rows = with_blocks(samples.select("series_id", "sample_idx", checked(F.col("value")).alias("value"))).repartition("series_id", "block_no")
    return rows.sortWithinPartitions("series_id", "block_no", "pos").select("series_id", "block_no", "value").mapInArrow(run, "series_id string, value float, decoded float")


def invalid_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks that can't be decoded, each with its error; the others can be decoded."""
    ready(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                try:
                    codec.decode_blocks(_checked(part))
                except (CorruptedStream, ValueError) as e:
                    bad.append({"series_id": part.column(0)[0].as_py(), "block_no": part.column(1)[0].as_py(), "error_class": type(e).__name__, "message": str(e)})
            if bad:
                yield pa.RecordBatch.from_pylist(bad, schema=pa.schema([("series_id", pa.string()), ("block_no", pa.int64()), ("error_class", pa.string()), ("message", pa.string())]))

    return blocks.select(*_NAMES).mapInArrow(run, QUARANTINE)


def decode_series(blocks: DataFrame) -> DataFrame:
    """(series_id, sample_idx, value)."""
    return series_of_blocks(decode_blocks(blocks))


def slice_filter(start: int, count: int) -> Column:
    """Blocks that a range of samples meets; both bounds are literals on block_no, so they reach the scan."""
    return F.col("block_no").between(start // BLOCK, (start + count - 1) // BLOCK)


def decode_slice(blocks: DataFrame, start: int, count: int, series_id: str | None = None) -> DataFrame:
    """Samples start .. start + count - 1 of each series (or one)."""
    if start < 0 or count < 0:
        raise IndexError("slice is outside the stream")
    some = blocks if series_id is None else blocks.where(F.col("series_id") == series_id)
    if not count:
        return decode_series(some.where(F.lit(False)))
    return decode_series(some.where(slice_filter(start, count))).where(F.col("sample_idx").between(start, start + count - 1))


def decode_slices(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, series_id, sample_idx, value) of many requests (request_id, series_id, start, count).

    Requests are cut at block bounds and meet blocks by an equi-join on (series_id, block_no); each block is decoded once.
    """
    asked = requests.where("count > 0").withColumn("block_no", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + count - 1) div {BLOCK})")))
    wanted = blocks.join(asked.select("series_id", "block_no").distinct(), ["series_id", "block_no"], "left_semi")
    met = asked.join(decode_blocks(wanted), ["series_id", "block_no"])
    rows = met.select("request_id", "series_id", "start", "count", "start_sample", F.posexplode("values").alias("pos", "value")).withColumn("sample_idx", F.col("start_sample") + F.col("pos"))
    return rows.where("sample_idx >= start AND sample_idx < start + count").select("request_id", "series_id", "sample_idx", "value")


def record_offsets(blocks: DataFrame) -> DataFrame:
    """(series_id, block_no, byte_offset, start_sample, sample_count): where each record lies in its series' frame."""
    before = F.coalesce(F.sum("record_bytes").over(Window.partitionBy("series_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("series_id", "block_no", (before + HEADER_BYTES).alias("byte_offset"), "start_sample", F.col("sample_count").cast("long").alias("sample_count"))


def index_faults(entries: DataFrame) -> DataFrame:
    """Index entries that break a rule: contiguous samples, full blocks but the last, aligned and rising offsets from 64 on."""
    w = Window.partitionBy("series_id").orderBy("block_no")
    rows = entries.withColumns({"_end": F.lag(F.col("start_sample") + F.col("sample_count"), 1, 0).over(w), "_at": F.lag("byte_offset", 1, 0).over(w), "_next": F.lead("block_no").over(w)})
    bad = (F.col("start_sample") != F.col("_end")) | (F.col("byte_offset") % 64 != 0) | (F.col("byte_offset") <= F.col("_at")) | ((F.col("_at") == 0) & (F.col("byte_offset") != HEADER_BYTES))
    bad = bad | (F.col("_next").isNotNull() & (F.col("sample_count") != BLOCK)) | ~F.col("sample_count").between(1, BLOCK)
    return rows.where(bad).drop("_end", "_at", "_next")


def to_frames(blocks: DataFrame, config: CodecConfig) -> DataFrame:
    """(series_id, frame): export; a frame holds a whole series, so one series must fit a task."""
    from ..sources.frame import write_frame

    ready(blocks.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.sort_by("block_no").to_pylist()
        return pa.table({"series_id": [key[0].as_py()], "frame": pa.array([write_frame([_block(r) for r in rows], config)], pa.binary())})

    return blocks.select(*_NAMES).groupBy("series_id").applyInArrow(run, "series_id string, frame binary")


def from_frames(frames: DataFrame) -> DataFrame:
    """The block table of (series_id, frame)."""
    from ..sources.frame import read_blocks

    ready(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("series_id").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                _, blocks = read_blocks(data)
                n = len(blocks)
                yield _rows([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([i * BLOCK for i in range(n)], pa.int64())], blocks)

    return frames.select("series_id", "frame").mapInArrow(run, TABLE)


def frame_sizes(blocks: DataFrame, config: CodecConfig) -> DataFrame:
    """(series_id, samples, frame_bytes): how much room a frame will take, before it is written."""
    index = 12 + 16 * F.count("*") if config.enable_index else F.lit(0)
    return blocks.groupBy("series_id").agg(F.sum("sample_count").cast("long").alias("samples"), (F.sum("record_bytes") + HEADER_BYTES + index).alias("frame_bytes"))


def slice_faults(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """(series_id, samples) of the series that a slice would leave; decode_slice() returns what there is."""
    ends = blocks.groupBy("series_id").agg(F.max(F.col("start_sample") + F.col("sample_count")).alias("samples"))
    return ends.where(F.lit(start + count) > F.col("samples"))


def rate_faults(blocks: DataFrame, config: CodecConfig) -> DataFrame:
    """Series whose frame would exceed its rate."""
    rows = frame_sizes(blocks, config)
    return rows.where(F.col("frame_bytes") > F.floor(F.col("samples") * config.target_rate / 8))


__all__ = ["RateBudgetExceeded", "TABLE", "decode_blocks", "decode_series", "decode_slice", "decode_slices", "encode_blocks", "from_frames", "index_faults", "invalid_blocks", "rate_faults", "record_offsets", "roundtrip", "to_frames"]
