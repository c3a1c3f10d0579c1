"""Tokens of error-bounded blocks: runs of zero quanta, and folded quanta."""

from __future__ import annotations

import numpy as np

from ..errors import CorruptedStream
from ..functions.varint import leb_decode, leb_lengths, unzigzag, zigzag


def encode(quanta: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token bytes of each row (padded) and their lengths."""
    n, width = quanta.shape
    used = np.arange(width) < count[:, None]
    zero = (quanta == 0) & used
    begins = zero.copy()
    begins[:, 1:] &= ~zero[:, :-1]
    event = begins | (used & ~zero)
    row, col = np.nonzero(event)
    is_run = begins[row, col]
    # a run ends where the next event of its row, or the row, begins
    nxt = np.append(col[1:], 0)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    run = np.where(last, count[row], nxt) - col if len(row) else np.zeros(0, np.int64)
    value = np.where(is_run, run.astype(np.uint64), zigzag(quanta[row, col]))
    size = 1 + leb_lengths(value)
    ends = np.cumsum(size)
    length = np.bincount(row, weights=size, minlength=n).astype(np.int64)
    begin = np.cumsum(length) - length
    out = np.zeros((n, int(length.max()) if n else 0), np.uint8)
    at = ends - size - begin[row]
    out[row, at] = ~is_run
    for k in range(int(size.max()) - 1 if len(size) else 0):
        some = np.flatnonzero(size > k + 1)
        out[row[some], at[some] + 1 + k] = ((value[some] >> np.uint64(7 * k)) & np.uint64(0x7F)) | np.where(size[some] > k + 2, 0x80, 0).astype(np.uint64)
    return out, length


def decode(tokens: np.ndarray, count: int) -> np.ndarray:
    """The quanta of one row's token bytes."""
    if len(tokens) > 7 * count + 2:
        raise CorruptedStream("too many error tokens")
    data = np.ascontiguousarray(tokens)
    if not len(data):
        if count:
            raise CorruptedStream("error tokens do not fill their block")
        return np.zeros(0, np.int64)
    # a tag is a one-byte integer too, so the bytes are integers in a row: tag, value, tag, value
    value = leb_decode(data, most=5)
    size = np.diff(np.flatnonzero(data < 0x80), prepend=-1)
    if len(value) % 2 or (size[::2] != 1).any() or (value[::2] > 1).any() or (value[1::2] == 0).any():
        raise CorruptedStream("invalid error tokens")
    quantum = value[::2] == 1
    value = value[1::2]
    width = np.where(quantum, np.uint64(1), value).astype(np.int64)
    if int(width.sum()) != count:
        raise CorruptedStream("error tokens do not fill their block")
    out = np.zeros(count, np.uint64)
    out[(np.cumsum(width) - width)[quantum]] = value[quantum]
    return unzigzag(out)
