"""Line-protocol text and compressed chunks of (timestamp, value) points.

Timestamps are int64 of no particular unit. A chunk holds them as delta-of-delta variable-length integers, exactly, and the values as a frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BLOCK
from ..errors import CorruptedStream
from ..functions.varint import leb_decode, leb_encode, unzigzag, zigzag
from ..operators.codec import SIDE
from ..session import ready
from . import frame

#: Fixed values of the chunk format.
CHUNK_MAGIC, CHUNK_HEADER = 0x42445441, 20


def separator(text: str, start: int, wanted: str, quotes: bool) -> int:
    """The next unescaped separator, outside quotes if they count; -1 without one."""
    escaped = quoted = False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif quotes and c == '"':
            quoted = not quoted
        elif c == wanted and not quoted:
            return i
    return -1


def field_value(fields: str, name: str) -> float:
    """The first numeric field of this name (any, if empty). Strings and the words true and false are passed over."""
    at = 0
    while at < len(fields):
        end = separator(fields, at, ",", True)
        field = fields[at : end if end >= 0 else len(fields)]
        eq = separator(field, 0, "=", True)
        if eq <= 0 or eq + 1 == len(field):
            raise ValueError("invalid field set")
        value = field[eq + 1 :]
        if (not name or field[:eq] == name) and value[0] != '"' and value not in ("true", "false"):
            number = value[:-1] if value[-1] in "iu" else value
            try:
                if not number or "_" in number or number != number.strip():
                    raise ValueError(number)
                with np.errstate(over="ignore"):
                    parsed = float(np.float32(float.fromhex(number) if number.lower().lstrip("+-").startswith("0x") else float(number)))
            except ValueError:
                raise ValueError("field is not a finite float") from None
            if not np.isfinite(parsed):
                raise ValueError("field is not a finite float")
            return parsed
        if end < 0:
            break
        at = end + 1
    raise ValueError("requested numeric field is missing")


def parse_line(line: str, name: str = "") -> tuple[int, float]:
    """(timestamp, value) of one line. Measurement and tags are skipped."""
    fields_at = separator(line, 0, " ", False)
    if fields_at < 0:
        raise ValueError("point is missing fields and timestamp")
    stamp_at = separator(line, fields_at + 1, " ", True)
    if stamp_at < 0 or stamp_at + 1 == len(line):
        raise ValueError("point is missing a timestamp")
    stamp = line[stamp_at + 1 :]
    digits = stamp[1:] if stamp[0] == "-" else stamp
    if not (digits.isascii() and digits.isdigit()) or not -(2**63) <= int(stamp) < 2**63:
        raise ValueError("invalid timestamp")
    return int(stamp), field_value(line[fields_at + 1 : stamp_at], name)


def parse_lines(text: str, name: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Points of a text; a carriage return at a line's end and empty lines are passed over."""
    points = [parse_line(x, name) for line in text.split("\n") if (x := line.removesuffix("\r"))]
    return np.array([t for t, _ in points], np.int64), np.array([v for _, v in points], np.float32)


def read_lines(lines: DataFrame, name: str = "", column: str = "line") -> DataFrame:
    """Points (ts, value) of a table of lines, with its other columns. Invalid lines have a null ts and value and say why in error."""
    ready(lines.sparkSession)
    kept = [c for c in lines.columns if c not in ("ts", "value", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*kept).schema) + ", ts long, value float, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, value, error, keep = [], [], [], []
            for i, line in enumerate(b.column(column).to_pylist()):
                line = (line or "").removesuffix("\r")
                if not line:
                    continue
                keep.append(i)
                try:
                    t, v = parse_line(line, name)
                    e = None
                except ValueError as wrong:
                    t = v = None
                    e = str(wrong)
                ts.append(t)
                value.append(v)
                error.append(e)
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ts, pa.int64()), pa.array(value, pa.float32()), pa.array(error, pa.string())], names=[*b.schema.names, "ts", "value", "error"])

    return lines.select(*kept).mapInArrow(run, schema)


def plain_point(line: Column, name: str) -> tuple[Column, Column]:
    """(timestamp, value) of lines without escapes and quotes, by column functions alone; null where the form is another."""
    number = rf"(?:^|,){name}=([-+0-9.eE]+)[iu]?(?:,|$)"
    fields = F.regexp_extract(line, r"^[^ ]+ ([^ ]+) (-?\d+)$", 1)
    stamp = F.regexp_extract(line, r"^[^ ]+ ([^ ]+) (-?\d+)$", 2)
    value = F.regexp_extract(fields, number, 1)
    return F.when(stamp != "", stamp.cast("long")), F.when(value != "", value.cast("float"))


def write_chunk(ts: np.ndarray, values: np.ndarray, repeats: bool = False, **settings) -> bytes:
    """A chunk of points whose timestamps strictly rise; with ``repeats`` they may also stay."""
    return write_chunks([(ts, values)], repeats, **settings)[0]


def write_chunks(points: list[tuple[np.ndarray, np.ndarray]], repeats: bool = False, **settings) -> list[bytes]:
    """write_chunk() of each (timestamps, values), with all blocks coded side by side."""
    heads = [_write_stamps(np.asarray(ts, np.int64), len(values), repeats) for ts, values in points]
    frames = frame.compress_many([np.asarray(values, np.float32) for _, values in points], **settings)
    return [h + f for h, f in zip(heads, frames, strict=True)]


def _write_stamps(ts: np.ndarray, values: int, repeats: bool) -> bytes:
    if len(ts) != values:
        raise ValueError("timestamps and values have different lengths")
    if not len(ts):
        raise ValueError("a chunk needs points")
    stamps = ts.tolist()
    deltas = [b - a for a, b in zip(stamps, stamps[1:], strict=False)]
    if any(d < (0 if repeats else 1) for d in deltas):
        raise ValueError("timestamps must not fall" if repeats else "timestamps must be strictly increasing")
    if any(d >= 2**63 for d in deltas):
        raise ValueError("timestamp delta overflows")
    delta = np.array(deltas, np.int64)
    packed = leb_encode(zigzag(np.diff(delta, prepend=np.int64(0))))
    return struct.pack("<IIIq", CHUNK_MAGIC, len(ts), len(packed), stamps[0]) + packed


def read_chunk(data: bytes, repeats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(timestamps, values) of a chunk; ``repeats``: as it was written."""
    return read_chunks([data], repeats)[0]


def read_chunks(chunks: list[bytes], repeats: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """read_chunk() of each, with blocks decoded side by side."""
    seen = [_read_stamps(data, repeats) for data in chunks]
    values = frame.decompress_many([body for _, body in seen], [len(ts) for ts, _ in seen])
    return [(ts, v) for (ts, _), v in zip(seen, values, strict=True)]


def _read_stamps(data: bytes, repeats: bool) -> tuple[np.ndarray, bytes]:
    """A chunk's timestamps, and its frame."""
    if len(data) < CHUNK_HEADER:
        raise CorruptedStream("truncated chunk")
    magic, n, size, first = struct.unpack_from("<IIIq", data)
    if magic != CHUNK_MAGIC or CHUNK_HEADER + size > len(data):
        raise CorruptedStream("invalid chunk header")
    body = data[CHUNK_HEADER + size :]
    if frame.read_header(body).samples != n or n < 1:
        raise CorruptedStream("the chunk's counts disagree")
    dod = unzigzag(leb_decode(data[CHUNK_HEADER : CHUNK_HEADER + size]))
    if len(dod) != n - 1:
        raise CorruptedStream("the chunk's timestamps don't match its count")
    ts, delta, least = [first], 0, 0 if repeats else 1
    for d in dod.tolist():
        delta += d
        ts.append(ts[-1] + delta)
        if delta < least or ts[-1] >= 2**63:
            raise CorruptedStream("timestamps fall" if repeats else "timestamps are not strictly increasing")
    return np.array(ts, np.int64), body


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, np.ndarray, np.ndarray]]:
    """(series_id, chunk_no, timestamps, values) of each chunk of rows sorted by chunk."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        if b.column("ts").null_count:
            raise ValueError("a timestamp is null")
        series, no, ts, value = b.column("series_id"), b.column("chunk_no").to_numpy(), b.column("ts").to_numpy(), b.column("value").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(series.dictionary_encode("encode").indices.to_numpy()) != 0) | (np.diff(no) != 0)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            own = (series[a].as_py(), int(no[a]))
            if held and own != key:
                yield *key, *map(np.concatenate, zip(*held, strict=True))
                held = []
            key = own
            held.append((ts[a:e], value[a:e]))
    if held:
        yield *key, *map(np.concatenate, zip(*held, strict=True))


def encode_chunks(points: DataFrame, per_chunk: int = 120_000, repeats: bool = False, **settings) -> DataFrame:
    """(series_id, chunk_no, first_ts, n, chunk) of numbered points (series_id, sample_idx, ts, value), ``per_chunk`` points each.

    A task holds as many chunks as are coded side by side; timestamps strictly rise, or with ``repeats`` don't fall.
    """
    ready(points.sparkSession)

    def coded(held: list[tuple[str | None, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        made = write_chunks([(ts, value) for _, _, ts, value in held], repeats, **settings)
        series, no, ts, _ = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(series, pa.string()), pa.array(no, pa.int64()), pa.array([int(t[0]) for t in ts], pa.int64()), pa.array(list(map(len, ts)), pa.int64()), pa.array(made, pa.binary())], names=["series_id", "chunk_no", "first_ts", "n", "chunk"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = [], 0
        for chunk in _whole(batches):
            held.append(chunk)
            blocks += -(-len(chunk[2]) // BLOCK)
            if blocks >= SIDE:
                yield coded(held)
                held, blocks = [], 0
        if held:
            yield coded(held)

    rows = points.select("series_id", F.expr(f"sample_idx div {per_chunk}").alias("chunk_no"), "sample_idx", "ts", "value")
    rows = rows.repartition("series_id", "chunk_no").sortWithinPartitions("series_id", "chunk_no", "sample_idx")
    return rows.mapInArrow(run, "series_id string, chunk_no long, first_ts long, n long, chunk binary")


def decode_chunks(chunks: DataFrame, repeats: bool = False) -> DataFrame:
    """(series_id, chunk_no, i, ts, value) of (series_id, chunk_no, chunk); ``repeats``: as they were written."""
    ready(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, numbers, data = (b.column(c).to_pylist() for c in ("series_id", "chunk_no", "chunk"))
            points = np.cumsum([int.from_bytes(c[4:8], "little") for c in data])  # as the headers say; so many are decoded at once
            cuts = (np.flatnonzero(np.diff(points // (SIDE * BLOCK))) + 1).tolist()
            for a, e in zip([0, *cuts], [*cuts, len(data)], strict=True):
                for name, no, (ts, value) in zip(names[a:e], numbers[a:e], read_chunks(data[a:e], repeats), strict=True):
                    n = len(ts)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([no] * n, pa.int64()), pa.array(np.arange(n)), pa.array(ts), pa.array(value)], names=["series_id", "chunk_no", "i", "ts", "value"])

    return chunks.select("series_id", "chunk_no", "chunk").mapInArrow(run, "series_id string, chunk_no long, i long, ts long, value float")


def prometheus_points(series: DataFrame) -> DataFrame:
    """(series_id, sample_idx, ts, value) of rows (series_id, timestamps, values) with arrays of equal lengths."""
    same = F.when(F.size("timestamps") == F.size("values"), F.arrays_zip("timestamps", "values")).otherwise(F.raise_error(F.lit("timestamps and values have different lengths")).cast("array<struct<timestamps:bigint,values:float>>"))
    rows = series.select("series_id", F.posexplode(same).alias("sample_idx", "p"))
    return rows.select("series_id", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("p.timestamps").cast("long").alias("ts"), F.col("p.values").cast("float").alias("value"))
