"""Zig-zag folding and unsigned LEB128, on arrays."""

from __future__ import annotations

import numpy as np

from ..errors import CorruptedStream


def zigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint64)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def leb_lengths(u: np.ndarray) -> np.ndarray:
    """Bytes that each value takes."""
    u = np.asarray(u, np.uint64)
    return 1 + sum((u >= np.uint64(1) << np.uint64(7 * k)).astype(np.int64) for k in range(1, 10))


def leb_encode(u: np.ndarray) -> bytes:
    """All values in a row."""
    u = np.asarray(u, np.uint64)
    n = leb_lengths(u)
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max()) if len(u) else 0):
        some = np.flatnonzero(n > k)
        out[start[some] + k] = ((u[some] >> np.uint64(7 * k)) & np.uint64(0x7F)) | np.where(n[some] > k + 1, 0x80, 0).astype(np.uint64)
    return out.tobytes()


def leb_decode(data: bytes | np.ndarray, most: int = 10) -> np.ndarray:
    """All values of a byte string that must end with one. Encodings that aren't the shortest are read."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    if not len(b):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(b < 0x80)
    if not len(end) or end[-1] != len(b) - 1:
        raise CorruptedStream("a variable-length integer is cut off")
    start = np.concatenate(([0], end[:-1] + 1))
    n = end - start + 1
    if n.max() > most or most == 10 and (b[start[n == 10] + 9] > 1).any() or most == 5 and (b[start[n == 5] + 4] > 15).any():
        raise CorruptedStream("a variable-length integer is too long")
    out = np.zeros(len(end), np.uint64)
    for k in range(int(n.max())):
        some = np.flatnonzero(n > k)
        out[some] |= (b[start[some] + k].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * k)
    return out
