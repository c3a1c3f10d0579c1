"""MiniSEED 2 records, and .npy and raw float32 files, as tables of samples."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ready

#: Plain encodings, and for the compressed ones (encoding, control, dnib or None): width and number of differences in a word.
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
PACKING = {
    (10, 1, None): (8, 4),
    (10, 2, None): (16, 2),
    (10, 3, None): (32, 1),
    (11, 1, None): (8, 4),
    (11, 2, 1): (30, 1),
    (11, 2, 2): (15, 2),
    (11, 2, 3): (10, 3),
    (11, 3, 0): (6, 5),
    (11, 3, 1): (5, 6),
    (11, 3, 2): (4, 7),
}


def signed(v: np.ndarray, width: int) -> np.ndarray:
    half = np.int64(1) << np.int64(width - 1)
    return (v.astype(np.int64) ^ half) - half


def differences(words: np.ndarray, control: np.ndarray, encoding: int) -> np.ndarray:
    """The differences of a record's data words in order, the words of one packing all at once."""
    dnib = np.where((encoding == 11) & (control > 1), words >> 30, 99)
    size = np.zeros(len(words), np.int64)
    done = control == 0
    parts = []
    for (kind, c, d), (width, n) in PACKING.items():
        some = np.flatnonzero((control == c) & (dnib == (99 if d is None else d))) if kind == encoding else np.zeros(0, np.int64)
        if len(some):
            shifts = np.arange(n - 1, -1, -1) * width
            parts.append((some, signed((words[some].astype(np.int64)[:, None] >> shifts) & ((1 << width) - 1), width)))
            size[some], done[some] = n, True
    if not done.all():
        raise ValueError("invalid Steim packing code")
    out = np.zeros(int(size.sum()), np.int64)
    start = np.cumsum(size) - size
    for some, values in parts:
        out[start[some][:, None] + np.arange(values.shape[1])] = values
    return out


def steim(record: bytes, data_at: int, count: int, encoding: int, order: str) -> np.ndarray:
    """Samples of a record: a running sum of differences from the first sample, checked against the last."""
    if data_at < 48 or len(record) - data_at < 64 or (len(record) - data_at) % 64:
        raise ValueError("invalid Steim frame region")
    frames = np.frombuffer(record, order + "u4", offset=data_at).reshape(-1, 16).astype(np.uint32)
    control = (frames[:, :1] >> (30 - 2 * np.arange(1, 16, dtype=np.uint32))) & 3
    control[0, :2] = 0
    made = differences(frames[:, 1:].ravel(), control.ravel(), encoding)
    first, last = (int(signed(frames[0, i : i + 1], 32)[0]) for i in (1, 2))
    if not count:
        return np.zeros(0, np.int64)
    if len(made) < count:
        raise ValueError("too few differences")
    # the first difference leads from the record before; the stored first sample stands for it
    values = first + np.concatenate(([0], np.cumsum(made[1:count])))
    if values[-1] != last:
        raise ValueError("the last sample doesn't match")
    return values


def byte_order(head: bytes) -> str:
    for order in "><":
        year, day = struct.unpack_from(order + "HH", head, 20)
        data_at, blockette = struct.unpack_from(order + "HH", head, 44)
        if 1900 <= year <= 2200 and 1 <= day <= 366 and data_at >= 48 and (not blockette or blockette >= 48):
            return order
    raise ValueError("invalid record header")


def decode_mseed(data: bytes) -> np.ndarray:
    """All samples of records in a row: int64, or float64 if any record holds floats."""
    if not data:
        raise ValueError("empty seismic data")
    out, at = [], 0
    while at < len(data):
        rest = data[at:]
        if len(rest) < 56:
            raise ValueError("truncated record header")
        order = byte_order(rest)
        count = struct.unpack_from(order + "H", rest, 30)[0]
        data_at, blockette = struct.unpack_from(order + "HH", rest, 44)
        layout, seen = None, set()
        while blockette:
            if blockette in seen or blockette < 48 or blockette + 4 > len(rest):
                raise ValueError("invalid blockette chain")
            seen.add(blockette)
            kind, following = struct.unpack_from(order + "HH", rest, blockette)
            if kind == 1000:
                if blockette + 8 > len(rest):
                    raise ValueError("truncated blockette")
                encoding, words, power = rest[blockette + 4 : blockette + 7]
                if words > 1 or not 8 <= power <= 20:
                    raise ValueError("invalid blockette")
                layout = encoding, ">" if words else "<", 1 << power
            blockette = following
        if layout is None:
            raise ValueError("the record has no blockette 1000")
        encoding, words, size = layout
        if size > len(rest) or data_at >= size:
            raise ValueError("truncated record")
        record = rest[:size]
        if encoding in (10, 11):
            out.append(steim(record, data_at, count, encoding, words))
        elif encoding in PLAIN:
            kind = np.dtype(words + PLAIN[encoding])
            if count * kind.itemsize > size - data_at:
                raise ValueError("more samples than the record holds")
            out.append(np.frombuffer(record, kind, count, data_at).astype(np.int64 if kind.kind == "i" else float))
        else:
            raise ValueError(f"unsupported encoding {encoding}")
        at += size
    return np.concatenate(out)


def encode_mseed(values: np.ndarray, power: int = 9) -> bytes:
    """Whole samples as records of 2 ** power bytes of plain 32-bit integers, big-endian, for tests and for export."""
    values = np.asarray(values)
    if values.ndim != 1 or not np.array_equal(values, values.astype(np.int32)):
        raise ValueError("one-dimensional 32-bit integers are needed")
    room = ((1 << power) - 64) // 4
    out = []
    for number, a in enumerate(range(0, len(values), room)):
        part = values[a : a + room].astype(">i4")
        head = struct.pack(">6sBB5s2s3s2sHHBBBBHHhhBBBBiHH", b"%06d" % (number % 1_000_000), ord("D"), 32, b"TEL  ", b"  ", b"BHZ", b"XX", 2020, 1, 0, 0, 0, 0, 0, len(part), 1, 1, 0, 0, 0, 1, 0, 64, 48)
        record = head + struct.pack(">HHBBBB", 1000, 0, 3, 1, power, 0) + bytes(8) + part.tobytes()
        out.append(record + bytes((1 << power) - len(record)))
    return b"".join(out)


READERS = {"mseed": decode_mseed, "npy": lambda d: np.load(io.BytesIO(d), allow_pickle=False), "f32": lambda d: np.frombuffer(d, "<f4")}


def decode_files(files: DataFrame, kind: str) -> DataFrame:
    """(path, sample_idx, value as double) of (path, content); ``kind`` is mseed, npy or f32. A file is one series."""
    ready(files.sparkSession)
    read = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.asarray(read(content)).astype(float)
                if x.ndim != 1:
                    raise ValueError("samples must be one-dimensional")
                for a in range(0, len(x), 65_536):
                    part = x[a : a + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["path", "sample_idx", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_idx long, value double")


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(path), kind)
