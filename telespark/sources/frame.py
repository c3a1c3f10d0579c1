"""Binary frames: a header, aligned block records, and an optional index of them."""

from __future__ import annotations

import struct
from collections import OrderedDict
from typing import NamedTuple

import numpy as np

from ..config import BLOCK, ERROR_MODE, HEADER_BYTES, MAX_BUFFER, MAX_SAMPLES, RECORD_FIXED, CodecConfig, align64
from ..errors import CorruptedStream, DeprecatedWireFormat, RateBudgetExceeded, UnsupportedWireFormat
from ..functions.checksum import crc32c, crc32c_many
from ..operators.codec import SIDE, Block, decode_blocks, encode_many, encode_series, read_body, records

#: Fixed values of the format.
MAGIC, VERSION, OLDEST = 0x41455448, 6, 5
FLAG_ERROR, FLAG_INDEX = 1, 2
INDEX_MAGIC = 0x41494458


class Header(NamedTuple):
    samples: int
    blocks: int
    flags: int

    @property
    def indexed(self) -> bool:
        return bool(self.flags & FLAG_INDEX)


class Entry(NamedTuple):
    byte_offset: int
    start_sample: int
    sample_count: int


def write_header(samples: int, blocks: int, flags: int) -> bytes:
    return struct.pack("<IHHQII", MAGIC, VERSION, 0, samples, blocks, flags) + bytes(40)


def write_frame(blocks: list[Block], config: CodecConfig) -> bytes:
    """The frame of a series' blocks."""
    return write_frames([blocks], config)[0]


def write_frames(series: list[list[Block]], config: CodecConfig) -> list[bytes]:
    """The frame of each series' blocks."""
    made = iter(records([b for blocks in series for b in blocks]))
    return [_frame(blocks, [next(made)[0] for _ in blocks], config) for blocks in series]


def _frame(blocks: list[Block], written: list[bytes], config: CodecConfig) -> bytes:
    samples = sum(b.count for b in blocks)
    flags = FLAG_ERROR * config.error_bounded | FLAG_INDEX * config.enable_index
    parts, at, start, entries = [write_header(samples, len(blocks), flags)], HEADER_BYTES, 0, []
    for b, record in zip(blocks, written, strict=True):
        entries.append(struct.pack("<QII", at, start, b.count))
        parts.append(record)
        at, start = at + len(record), start + b.count
    if config.enable_index:
        footer = struct.pack("<II", len(blocks), INDEX_MAGIC) + b"".join(entries)
        parts += [footer, struct.pack("<I", crc32c(footer))]
    frame = b"".join(parts)
    if not config.error_bounded and len(frame) > int(samples * config.target_rate // 8):
        raise RateBudgetExceeded("serialized frame exceeds the requested rate")
    return frame


def compress(samples: np.ndarray, target_rate: float = 4.0, absolute_error: float = 0.0, deadzone: float = 0.3, enable_index: bool = False, adaptive_tail: bool = True) -> bytes:
    """Samples to a frame."""
    config = CodecConfig(target_rate, absolute_error, deadzone, enable_index, adaptive_tail)
    return write_frame(encode_series(np.asarray(samples, np.float32), config), config)


def compress_many(series: list[np.ndarray], **settings) -> list[bytes]:
    """compress() of each, with all blocks coded side by side."""
    config = CodecConfig(**settings)
    return write_frames(encode_many(series, config), config)


def read_header(data: bytes) -> Header:
    if len(data) < HEADER_BYTES:
        raise CorruptedStream("truncated frame header")
    magic, version, reserved, samples, blocks, flags = struct.unpack_from("<IHHQII", data)
    if magic != MAGIC:
        raise CorruptedStream("bad frame magic")
    if version == OLDEST and flags & FLAG_INDEX:
        raise DeprecatedWireFormat("indexed frames of this wire version have no settled layout")
    if not OLDEST <= version <= VERSION:
        raise UnsupportedWireFormat(f"unsupported wire version {version}")
    if reserved or any(data[24:HEADER_BYTES]) or flags & ~(FLAG_ERROR | FLAG_INDEX):
        raise CorruptedStream("reserved header bits are set")
    if blocks != -(-samples // BLOCK):
        raise CorruptedStream("block count does not match the sample count")
    return Header(samples, blocks, flags)


def record_at(data: bytes, at: int, end: int) -> tuple[bytes, int, int]:
    """A record's body, its stored checksum, and where the record ends."""
    if at + 4 > end:
        raise CorruptedStream("truncated block record")
    size = struct.unpack_from("<I", data, at)[0]
    stop = at + align64(size + 8)
    if not 28 <= size <= 16 << 20 or stop > end:
        raise CorruptedStream("invalid or truncated block record")
    if any(data[at + 8 + size : stop]):
        raise CorruptedStream("record padding is not zero")
    return data[at + 4 : at + 4 + size], struct.unpack_from("<I", data, at + 4 + size)[0], stop


def checked_bodies(found: list[tuple[bytes, int]], error_bounded: bool | list[bool]) -> list[Block]:
    """Blocks of bodies whose checksums are right, before anything in them is read; error_bounded: of their frame, or one for each."""
    if crc32c_many([b for b, _ in found]).tolist() != [c for _, c in found]:
        raise CorruptedStream("block checksum mismatch")
    blocks = [read_body(b) for b, _ in found]
    modes = error_bounded if isinstance(error_bounded, list) else [error_bounded] * len(blocks)
    if any((b.quant_mode == ERROR_MODE) != e for b, e in zip(blocks, modes, strict=True)):
        raise CorruptedStream("a block's mode contradicts its frame")
    return blocks


def read_index(data: bytes, header: Header) -> list[Entry]:
    """The index footer, checked."""
    size = 8 + 16 * header.blocks
    at = len(data) - size - 4
    if not header.indexed or at < HEADER_BYTES:
        raise CorruptedStream("the frame has no index")
    if struct.unpack_from("<I", data, at + size)[0] != crc32c(data[at : at + size]):
        raise CorruptedStream("index checksum mismatch")
    n, magic = struct.unpack_from("<II", data, at)
    if n != header.blocks or magic != INDEX_MAGIC:
        raise CorruptedStream("invalid index header")
    entries = [Entry(*x) for x in struct.iter_unpack("<QII", data[at + 8 : at + size])]
    start, before = 0, 0
    for i, e in enumerate(entries):
        if e.start_sample != start or e.sample_count != min(BLOCK, header.samples - start) or e.byte_offset % 64 or e.byte_offset <= before or e.byte_offset >= at or not i and e.byte_offset != HEADER_BYTES:
            raise CorruptedStream("invalid index entry")
        start, before = start + e.sample_count, e.byte_offset
    return entries


def read_blocks(data: bytes) -> tuple[Header, list[Block]]:
    """Every block of a whole frame, with all structural checks, the index against what is there included."""
    return read_many([data])[0]


def read_many(frames: list[bytes]) -> list[tuple[Header, list[Block]]]:
    """read_blocks() of each, with all checksums taken together."""
    seen = [_records(data) for data in frames]
    blocks = checked_bodies([x for _, found, _ in seen for x in found], [bool(h.flags & FLAG_ERROR) for h, found, _ in seen for _ in found])
    out, at = [], 0
    for data, (header, found, offsets) in zip(frames, seen, strict=True):
        own = blocks[at : at + len(found)]
        at += len(found)
        if [b.count for b in own] != [min(BLOCK, header.samples - i * BLOCK) for i in range(header.blocks)]:
            raise CorruptedStream("a block has the wrong number of samples")
        if header.indexed and [e.byte_offset for e in read_index(data, header)] != offsets:
            raise CorruptedStream("the index does not match the blocks")
        out.append((header, own))
    return out


def _records(data: bytes) -> tuple[Header, list[tuple[bytes, int]], list[int]]:
    """A frame's header, its records' bodies with their checksums, and where the records lie."""
    header = read_header(data)
    end = len(data) - (12 + 16 * header.blocks if header.indexed else 0)
    if header.blocks > (end - HEADER_BYTES) // 64:
        raise CorruptedStream("the frame is too short for its blocks")
    at, found, offsets = HEADER_BYTES, [], []
    for _ in range(header.blocks):
        offsets.append(at)
        body, crc, at = record_at(data, at, end)
        found.append((body, crc))
    if at != end:
        raise CorruptedStream("trailing bytes after the last block")
    return header, found, offsets


def decompress(data: bytes, length: int | None = None) -> np.ndarray:
    """All samples of a frame."""
    return decompress_many([data], None if length is None else [length])[0]


def decompress_many(frames: list[bytes], lengths: list[int] | None = None) -> list[np.ndarray]:
    """decompress() of each, with blocks decoded side by side."""
    read = read_many(list(map(bytes, frames)))
    if lengths is not None and [h.samples for h, _ in read] != lengths:
        raise CorruptedStream("the frame has another number of samples")
    blocks = [b for _, own in read for b in own]
    parts = iter([x for a in range(0, len(blocks), SIDE) for x in decode_blocks(blocks[a : a + SIDE])])
    return [np.concatenate([np.zeros(0, np.float32), *(next(parts) for _ in own)]) for _, own in read]


class IndexedView:
    """Random access to an indexed frame, which is checked once; a slice reads only the records it meets, and the last ``keep`` blocks stay decoded."""

    def __init__(self, data: bytes, keep: int = 64) -> None:
        self.data = bytes(data)
        self.header = read_header(self.data)
        self.entries = read_index(self.data, self.header)
        self.keep = keep
        self.recent: OrderedDict[int, np.ndarray] = OrderedDict()

    def __len__(self) -> int:
        return self.header.samples

    def slice(self, start: int, count: int) -> np.ndarray:
        if start < 0 or count < 0 or start + count > self.header.samples:
            raise IndexError("slice is outside the stream")
        if not count:
            return np.zeros(0, np.float32)
        lo, hi = start // BLOCK, (start + count - 1) // BLOCK
        wanted = {i: self.recent.pop(i, None) for i in range(lo, hi + 1)}
        if missing := [i for i, x in wanted.items() if x is None]:
            wanted.update(zip(missing, self._read(missing), strict=True))
        self.recent.update(wanted)
        while len(self.recent) > self.keep:
            self.recent.popitem(last=False)
        # a copy, so that what a caller does to it stays with the caller
        return np.concatenate([wanted[i] for i in range(lo, hi + 1)])[start - lo * BLOCK :][:count]

    def _read(self, numbers: list[int]) -> list[np.ndarray]:
        end = len(self.data) - (12 + 16 * self.header.blocks)
        found = []
        for i in numbers:
            body, crc, stop = record_at(self.data, self.entries[i].byte_offset, end)
            if stop != (self.entries[i + 1].byte_offset if i + 1 < len(self.entries) else end):
                raise CorruptedStream("a record does not end where the next begins")
            found.append((body, crc))
        blocks = checked_bodies(found, bool(self.header.flags & FLAG_ERROR))
        if [b.count for b in blocks] != [self.entries[i].sample_count for i in numbers]:
            raise CorruptedStream("a block's count contradicts the index")
        return decode_blocks(blocks)


def decompress_slice(data: bytes, start: int, count: int) -> np.ndarray:
    return IndexedView(data).slice(start, count)


class StreamEncoder:
    """Packets of any length in, a frame of one block out for every full block; flush() ends with the short one."""

    def __init__(self, target_rate: float = 4.0, absolute_error: float = 0.0, deadzone: float = 0.3) -> None:
        self.config = CodecConfig(target_rate, absolute_error, deadzone)
        self.held = np.zeros(0, np.float32)

    def feed(self, samples: np.ndarray) -> bytes:
        new = np.asarray(samples, np.float32).ravel()
        if not np.isfinite(new).all():  # before any state changes
            raise ValueError("input contains a non-finite value")
        every = np.concatenate([self.held, new])
        full = len(every) // BLOCK * BLOCK
        out = b"".join(self._frame(every[a : a + BLOCK]) for a in range(0, full, BLOCK))
        self.held = every[full:]
        return out

    def flush(self) -> bytes:
        out = self._frame(self.held) if len(self.held) else b""
        self.held = np.zeros(0, np.float32)
        return out

    def _frame(self, part: np.ndarray) -> bytes:
        return write_frame(encode_series(part, self.config), self.config)


def frame_length(data: bytes) -> int | None:
    """Bytes of the frame at the front of ``data``; None while that can't be told yet."""
    if len(data) < HEADER_BYTES:
        return None
    header = read_header(data)
    if header.samples > MAX_SAMPLES:
        raise CorruptedStream("the frame is too large to buffer")
    at = HEADER_BYTES
    for _ in range(header.blocks):
        if len(data) < at + 4:
            return None
        size = struct.unpack_from("<I", data, at)[0]
        if not 28 <= size <= 16 << 20:
            raise CorruptedStream("invalid block record")
        at += align64(size + RECORD_FIXED - 28)
    at += 12 + 16 * header.blocks if header.indexed else 0
    return at if len(data) >= at else None


class StreamDecoder:
    """Bytes in fragments in, the samples of every complete frame out."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> np.ndarray:
        if len(self.held) + len(data) > MAX_BUFFER:
            raise CorruptedStream("too many bytes without a complete frame")
        self.held += bytes(data)
        out = []
        while (n := frame_length(self.held)) is not None:
            out.append(decompress(self.held[:n]))
            self.held = self.held[n:]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def flush(self) -> None:
        if self.held:
            raise CorruptedStream("the stream ends within a frame")
