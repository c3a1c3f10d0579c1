"""Operator 4, media columns: Matroska.

``write`` lays a payload down as 8-bit PCM in clusters of laced blocks with cues; ``parse`` reads any such container
(variable-length element ids and sizes, unknown sizes, clusters, SimpleBlocks and BlockGroups, all four lacings, cues) into
a packet table: track, timestamp, byte offset, size, cluster, flags. ``packet_table`` is that over a binary column.

Defined cases: a null or empty text gives a payload of 64 zero bytes; equal texts give equal containers; repeated rows
give repeated results; an empty table gives an empty table; other columns are ignored; a text is one payload, however long;
malformed containers raise MatroskaError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Element ids of the format.
EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP_SCALE, DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0x23E383
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, CUES, TRACKS, INFO, BLOCK_GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE = 8_000
#: Samples of a packet, packets of a block, blocks of a cluster. One packet lasts 64 ms.
FRAME, LACED, BLOCKS = 512, 8, 8
FRAME_MS = FRAME * 1000 // RATE
ALIGN = 64


class MatroskaError(ValueError):
    """The bytes are not a readable container."""


class Packet(NamedTuple):
    track: int
    timestamp_ms: int
    offset: int
    size: int
    cluster: int
    keyframe: bool


class Cue(NamedTuple):
    timestamp_ms: int
    track: int
    cluster_offset: int


class Parsed(NamedTuple):
    packets: list[Packet]
    cues: list[Cue]
    clusters: list[int]
    tracks: list[dict]


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; the shortest whose bits are not all ones, unless a width is given."""
    if not width:
        width = 1
        while value >= (1 << (7 * width)) - 1:
            width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header (number of frames less one, sizes) and the frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    size = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in size[:-1])
    elif kind == EBML_LACING:
        head += vint(size[0])
        for before, n in zip(size, size[1:-1], strict=False):
            width, step = 1, n - before
            while abs(step) > (1 << (7 * width - 1)) - 1:
                width += 1
            head += vint(step + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1)
        + uint(TRACK_UID, 1)
        + uint(TRACK_TYPE, 2)
        + uint(FLAG_LACING, 1)
        + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, real(SAMPLING_FREQUENCY, RATE) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    """A container with one track of 8-bit samples at 8 kHz that holds the payload losslessly."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE) + element(0x4D80, b"telespark") + element(0x5741, b"telespark"))
    head = info + _TRACKS
    body, cues, at = [head], [], len(head)
    per_cluster = FRAME * LACED * BLOCKS
    for c in range(0, len(payload), per_cluster):
        part = payload[c : c + per_cluster]
        start = c // FRAME * FRAME_MS
        blocks = [uint(TIMESTAMP, start)]
        for b in range(0, len(part), FRAME * LACED):
            frames = [part[i : min(i + FRAME, b + FRAME * LACED)] for i in range(b, min(b + FRAME * LACED, len(part)), FRAME)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[0]) == len(frames[-1]) else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b // FRAME * FRAME_MS, 0x80 | kind << 1) + lace(frames, kind)))
        made = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(made)
        at += len(made)
    return _HEADER + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_vint(data: bytes, at: int, end: int, marker: bool) -> tuple[int | None, int]:
    """The integer at ``at`` and where it ends; None for a size of all ones (unknown)."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end or marker and width > 4:
        raise MatroskaError(f"the variable-length integer at byte {at} is cut off")
    raw = int.from_bytes(data[at : at + width], "big")
    if marker:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def laced_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The frames' sizes and where the first begins."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a lacing header is cut off")
    n, at = data[at] + 1, at + 1
    size: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise MatroskaError("fixed lacing does not divide its block")
        return [(end - at) // n] * n, at
    for i in range(n - 1):
        if kind == XIPH:
            total = 0
            while True:
                if at >= end:
                    raise MatroskaError("a lacing header is cut off")
                total, last, at = total + data[at], data[at], at + 1
                if last < 255:
                    break
            size.append(total)
        else:
            first = at
            value, at = read_vint(data, at, end, False)
            if value is None:
                raise MatroskaError("a laced size is unknown")
            size.append(value if not i else size[-1] + value - ((1 << (7 * (at - first) - 1)) - 1))
    size.append(end - at - sum(size))
    if min(size) < 0:
        raise MatroskaError("laced sizes exceed their block")
    return size, at


def parse(data: bytes) -> Parsed:
    """All packets in stored order, cues, cluster offsets and track entries. Offsets count from the first byte of ``data``."""
    packets: list[Packet] = []
    cues: list[Cue] = []
    clusters: list[int] = []
    tracks: list[dict] = []
    durations: dict[int, int] = {}
    scale, segment_at, cluster_time = 1_000_000, 0, 0
    cue: dict[int, int] = {}
    # an explicit stack of (id, end); an unknown-sized element ends where an element of its own level or above begins
    stack: list[tuple[int, int, bool]] = []
    at, size_all = 0, len(data)
    if not data.startswith(EBML.to_bytes(4, "big")):
        raise MatroskaError("no EBML header")
    while at < size_all or stack:
        end = stack[-1][1] if stack else size_all
        if stack and at >= end:
            done = stack.pop()[0]
            if done == CUE_POINT and CUE_CLUSTER_POSITION in cue:
                cues.append(Cue(cue.get(CUE_TIME, 0) * scale // 1_000_000, cue.get(CUE_TRACK, 0), segment_at + cue[CUE_CLUSTER_POSITION]))
            continue
        first = at
        ident, at = read_vint(data, at, end, True)
        size, at = read_vint(data, at, end, False)
        while stack and stack[-1][2] and (ident in TOP_LEVEL and stack[-1][0] != SEGMENT or ident in (EBML, SEGMENT)):
            stack.pop()
        end = stack[-1][1] if stack else size_all
        if size is None and ident not in (SEGMENT, CLUSTER) or size is not None and at + size > end:
            raise MatroskaError(f"element {ident:X} at byte {first} exceeds what holds it")
        stop = end if size is None else at + size
        if ident in MASTERS:
            stack.append((ident, stop, size is None))
            if ident == SEGMENT:
                segment_at = at
            elif ident == CLUSTER:
                clusters.append(first)
            elif ident == TRACK_ENTRY:
                tracks.append({})
            elif ident == CUE_POINT:
                cue = {}
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            track, body = read_vint(data, at, stop, False)
            if track is None or body + 3 > stop:
                raise MatroskaError(f"the block at byte {first} is cut off")
            relative, flags = struct.unpack_from(">hB", data, body)
            sizes, begin = laced_sizes(data, body + 3, stop, flags >> 1 & 3)
            time = (cluster_time + relative) * scale // 1_000_000
            step = durations.get(track, 0) // 1_000_000
            for i, n in enumerate(sizes):
                packets.append(Packet(track, time + i * step, begin, n, len(clusters) - 1, bool(flags & 0x80)))
                begin += n
        elif ident == TIMESTAMP:
            cluster_time = int.from_bytes(data[at:stop], "big")
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:stop], "big")
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            cue[ident] = int.from_bytes(data[at:stop], "big")
        elif tracks and ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
            tracks[-1][ident] = int.from_bytes(data[at:stop], "big")
            if TRACK_NUMBER in tracks[-1] and DEFAULT_DURATION in tracks[-1]:
                durations[tracks[-1][TRACK_NUMBER]] = tracks[-1][DEFAULT_DURATION]
        elif tracks and ident == CODEC_ID:
            tracks[-1][ident] = data[at:stop].decode("ascii", "replace")
        at = stop
    return Parsed(packets, cues, clusters, tracks)


def track_bytes(data: bytes, packets: list[Packet], track: int = 1) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in packets if p.track == track])


def pad(text: str | None) -> tuple[int, bytes]:
    """UTF-8 of a text, and that with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def feature(samples: bytes, parsed: Parsed) -> str:
    """Packet and cluster counts, duration and whole-number statistics of the samples that were read back."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};ms={len(x) * 1000 // RATE};sum={int(counts @ levels)};energy={int(counts @ (levels - 128) ** 2)};peak={int(x.max())};crossings={crossings}"


def mux_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: each text's payload as a container."""

    def work(batch: pa.RecordBatch) -> dict:
        made = [pad(t) for t in batch.column("text").to_pylist()]
        return {"k": batch.column(0), "n_bytes": [n for n, _ in made], "media": [write(p) for _, p in made]}

    kind = df.schema[key].dataType.simpleString()
    return map_text(df.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def packet_table(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of each container: track, timestamp_ms, byte_offset, byte_length, cluster, keyframe, and whether a cue points at its cluster."""
    made = "packets array<struct<track:int,timestamp_ms:long,byte_offset:long,byte_length:long,cluster:int,keyframe:boolean,cued:boolean>>"

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for data in batch.column("media").to_pylist():
            if data is None:
                out.append([])
                continue
            p = parse(data)
            cued = {c.cluster_offset for c in p.cues}
            out.append([{"track": x.track, "timestamp_ms": x.timestamp_ms, "byte_offset": x.offset, "byte_length": x.size, "cluster": x.cluster, "keyframe": x.keyframe, "cued": x.cluster >= 0 and p.clusters[x.cluster] in cued} for x in p.packets])
        return {"k": batch.column(0), "packets": out}

    kind = media.schema[key].dataType.simpleString()
    rows = map_text(media.select(F.col(key).alias("k"), F.col(column).alias("media")), work, f"k {kind}, {made}", "media")
    return rows.select(F.col("k").alias(key), F.explode("packets").alias("p")).select(key, "p.*")


def read_back(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, and digests of what is stored and of what the parsed packets hold."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column("media").to_pylist():
            parsed = parse(data)
            got = track_bytes(data, parsed.packets)
            for k, v in zip(out, (len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(got, parsed)), strict=True):
                out[k].append(v)
        return {"k": batch.column(0), "n_bytes": batch.column(1)} | out

    kind = media.schema[key].dataType.simpleString()
    made = map_text(media.select(F.col(key).alias("k"), "n_bytes", F.col(column).alias("media")), work, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")
    return made.withColumnRenamed("k", key)
