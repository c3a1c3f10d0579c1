"""CRC32-C of many byte strings at once.

A checksum is linear: leading zeros don't change it from state 0, and the state after A then B is A's state carried over B's length, plus B's
own. So strings are right-aligned in rows of 64-byte segments, all segments of all strings take 32 steps of two bytes side by side, and a row's
segments are joined by one table look-up for each. Rows hold strings of like lengths, so at most half of a batch is padding.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
SEGMENT = 64
_LOW = np.uint32(0xFFFF)
_HALF = np.uint32(16)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bytes' step from each low half of a state; and what a segment of zeros makes of the low and the high half."""
    step = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    low, high = np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << _HALF
    for _ in range(SEGMENT // 2):
        low, high = step[low & _LOW] ^ (low >> _HALF), step[high & _LOW] ^ (high >> _HALF)
    return step, low, high


def _rows(strings: list[bytes], width: int) -> np.ndarray:
    """Checksums of strings of 4 to ``width`` bytes, a multiple of SEGMENT."""
    step, low, high = _tables()
    n = len(strings)
    m = np.zeros((n, width), np.uint8)
    for i, x in enumerate(strings):
        m[i, width - len(x) :] = np.frombuffer(x, np.uint8)
        m[i, width - len(x) : width - len(x) + 4] ^= 0xFF  # starting from all ones
    words = np.ascontiguousarray(m.view("<u2").reshape(n, width // SEGMENT, SEGMENT // 2).transpose(2, 0, 1))
    state = np.zeros(words.shape[1:], np.uint32)
    for w in words:
        state = step[(state ^ w) & _LOW] ^ (state >> _HALF)
    total = np.zeros(n, np.uint32)
    for segment in state.T:
        total = low[total & _LOW] ^ high[total >> _HALF] ^ segment
    return ~total


def _short(data: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def crc32c_many(strings: list[bytes]) -> np.ndarray:
    """The checksum of each string, as uint32."""
    out = np.zeros(len(strings), np.uint32)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(strings):
        if len(x) < 4:
            out[i] = _short(x)
        else:
            by_size.setdefault(max(SEGMENT, len(x) - 1).bit_length(), []).append(i)
    for own in by_size.values():
        longest = max(len(strings[i]) for i in own)
        out[own] = _rows([strings[i] for i in own], -(-longest // SEGMENT) * SEGMENT)
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_many([bytes(data)])[0])
