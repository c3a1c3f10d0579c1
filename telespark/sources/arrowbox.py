"""Containers of float32 columns: one frame for each chunk of a column, behind a table of their sizes.

As tables: to_containers() codes rows of chunks where they lie and gathers their frames, from_containers() deals a container's frames out and decodes
them, both side by side in Arrow batches. A container is read in one piece, so its bytes must fit a task; its samples needn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import lists
from ..operators.codec import SIDE
from ..session import ready
from . import frame

#: Fixed values of the container: its header, and the entry of a chunk.
MAGIC, VERSION = b"AARW", 1
HEADER = np.dtype([("magic", "S4"), ("version", "<u2"), ("chunks", "<u2"), ("values", "<u8"), ("rate", "<f4")])
ENTRY = np.dtype([("bytes", "<u8"), ("values", "<u4")])
MOST_CHUNKS = np.iinfo(np.uint16).max

UNPACKED = "series_id string, chunk_no int, start_sample long, values array<float>"


class InvalidContainer(ValueError):
    """What is wrong with a container's bytes."""


def pack(chunks: list[np.ndarray], rate: float) -> bytes:
    """The container of a column's chunks; an empty chunk takes no bytes."""
    return box(frames_of(chunks, rate), [len(c) for c in chunks], rate)


def frames_of(chunks: list[np.ndarray], rate: float) -> list[bytes]:
    """A frame for each chunk, no bytes for an empty one."""
    made = iter(frame.compress_many([c for c in chunks if len(c)], target_rate=rate))
    return [next(made) if len(c) else b"" for c in chunks]


def samples_of(frames: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The chunks of frames_of()."""
    some = [(f, n) for f, n in zip(frames, lengths, strict=True) if f]
    made = iter(frame.decompress_many([f for f, _ in some], [n for _, n in some]))
    return [next(made) if f else np.zeros(0, np.float32) for f in frames]


def box(frames: list[bytes], lengths: list[int], rate: float) -> bytes:
    """The container of frames and how many values each has."""
    if len(frames) > MOST_CHUNKS:
        raise ValueError(f"a container holds {MOST_CHUNKS} chunks at most")
    entries = np.zeros(len(frames), ENTRY)
    entries["bytes"], entries["values"] = [len(f) for f in frames], lengths
    header = np.array([(MAGIC, VERSION, len(frames), int(entries["values"].sum(dtype=np.int64)), rate)], HEADER)
    return b"".join([header.tobytes(), entries.tobytes(), *frames])


def contents(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The header, and the chunks' entries with the offsets of their frames, once all of it is consistent."""
    if len(data) < HEADER.itemsize:
        raise InvalidContainer("shorter than a header")
    header = np.frombuffer(data, HEADER, 1)[0]
    body = HEADER.itemsize + ENTRY.itemsize * int(header["chunks"])
    known = header["magic"] == MAGIC and header["version"] == VERSION
    entries = np.frombuffer(data, ENTRY, int(header["chunks"]), HEADER.itemsize) if known and body <= len(data) else np.zeros(0, ENTRY)
    size = np.minimum(entries["bytes"], len(data) + 1).astype(np.int64)  # so that sums can't overflow
    end = body + np.cumsum(size)
    faults = {
        "not a container of this version": not known,
        "the table of chunks is cut off": body > len(data),
        "a rate outside 2 to 8": not 2 <= header["rate"] <= 8,
        "values without bytes": bool(((size == 0) & (entries["values"] > 0)).any()),
        "chunks don't fill the container": int(end[-1] if len(end) else body) != len(data),
        "chunks and header differ in values": int(entries["values"].sum(dtype=np.int64)) != int(header["values"]),
    }
    if found := [what for what, wrong in faults.items() if wrong]:
        raise InvalidContainer("; ".join(found))
    return header, np.rec.fromarrays([end - size, size, entries["values"].astype(np.int64)], names="at,bytes,values")


def unpack(data: bytes) -> list[np.ndarray]:
    """The chunks of a container."""
    _, entries = contents(data)
    return samples_of([data[e.at : e.at + e.bytes] for e in entries], entries["values"].tolist())


def compress_arrow(column: pa.Array | pa.ChunkedArray, target_rate: float = 3.0) -> pa.Buffer:
    """The container of an Arrow float32 column without nulls, its chunks kept apart."""
    if not isinstance(column, (pa.Array, pa.ChunkedArray)) or column.type != pa.float32():
        raise TypeError("an Arrow float32 column is needed")
    if column.null_count:
        raise ValueError("a column with nulls can't be encoded")
    return pa.py_buffer(pack([c.to_numpy() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])], target_rate))


def decompress_arrow(buffer: pa.Buffer | bytes, length: int) -> pa.Array:
    """All values of a container that is known to hold so many."""
    data = bytes(buffer)
    header, _ = contents(data)
    if length != int(header["values"]):
        raise InvalidContainer(f"{int(header['values'])} values, not {length}")
    return pa.array(np.concatenate([np.zeros(0, np.float32), *unpack(data)]), pa.float32())


def to_containers(chunks: DataFrame, rate: float = 3.0) -> DataFrame:
    """(series_id, container) of rows (series_id, chunk_no, values: array<float>), the chunks in order."""
    ready(chunks.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SIDE):
                part = batch.slice(a, SIDE)
                values = part.column("values")
                if values.null_count or values.flatten().null_count:
                    raise ValueError("a column with nulls can't be encoded")
                parts = lists(values, np.float32)
                yield pa.RecordBatch.from_arrays([part.column("series_id"), part.column("chunk_no"), pa.array(list(map(len, parts)), pa.int64()), pa.array(frames_of(parts, rate), pa.binary())], names=["series_id", "chunk_no", "n", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [box(row["frame"], row["n"], rate) for row in batch.select(["frame", "n"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(made, pa.binary())], names=["series_id", "container"])

    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}
    coded = chunks.select("series_id", "chunk_no", "values").mapInArrow(code, f"series_id {kind['series_id']}, chunk_no {kind['chunk_no']}, n long, frame binary")
    gathered = coded.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "n", "frame"))).alias("c"))
    return gathered.select("series_id", F.col("c.frame").alias("frame"), F.col("c.n").alias("n")).mapInArrow(gather, "series_id string, container binary")


def from_containers(containers: DataFrame) -> DataFrame:
    """The chunks of rows (series_id, container) as (series_id, chunk_no, start_sample, values)."""
    spark = ready(containers.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("series_id").to_pylist(), batch.column("container").to_pylist(), strict=True):
                _, entries = contents(data)
                size = entries["values"].copy()
                frames = pa.array([data[e.at : e.at + e.bytes] for e in entries], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(size), pa.string()), pa.array(range(len(size)), pa.int32()), pa.array(np.cumsum(size) - size), pa.array(size), frames], names=["series_id", "chunk_no", "start_sample", "n", "frame"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SIDE):
                part = batch.slice(a, SIDE)
                values = samples_of(part.column("frame").to_pylist(), part.column("n").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("series_id", "chunk_no", "start_sample")), pa.array(values, pa.list_(pa.float32()))], names=["series_id", "chunk_no", "start_sample", "values"])

    frames = containers.select("series_id", "container").mapInArrow(deal, "series_id string, chunk_no int, start_sample long, n long, frame binary")
    # a number of its own: so few bytes would else be put together in one task
    return frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series_id", "chunk_no").mapInArrow(decode, UNPACKED)
