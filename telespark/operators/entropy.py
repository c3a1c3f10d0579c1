"""Interleaved range coding of byte strings, all strings and lanes at once."""

from __future__ import annotations

import struct

import numpy as np

from ..config import LANES, LOWER, SCALE, SCALE_BITS
from ..errors import CorruptedStream

#: Fixed value: the payload's magic.
MAGIC = 0x31525341


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to SCALE, at least 1 where a symbol occurs; rows of 256 counts.

    What rounding down leaves goes to the largest remainders (then the smaller symbol); what the minimum of 1 takes
    too much comes off the most frequent symbol, the smallest first in ties.
    """
    w = np.asarray(counts, float)
    w = np.where(w.sum(axis=1, keepdims=True) > 0, w, 1.0)
    exact = w / w.sum(axis=1, keepdims=True) * SCALE
    f = np.where(w > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    left = SCALE - f.sum(axis=1)
    order = np.argsort(-(exact - np.floor(exact)), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(256), order.shape), axis=1)
    f += rank < left[:, None]
    for i in np.flatnonzero(left < 0).tolist():
        for _ in range(int(-left[i])):
            f[i, int(np.argmax(np.where(f[i] > 1, f[i], 0)))] -= 1
    return f


def encode(rows: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Payloads of the first ``length`` bytes of each row."""
    n, width = rows.shape
    turns = -(-width // LANES) if width else 0
    padded = np.zeros((n, turns * LANES), np.uint8)
    padded[:, :width] = rows
    used = np.arange(turns * LANES) < length[:, None]
    counts = np.bincount((np.repeat(np.arange(n), length) * 256 + padded[used]), minlength=n * 256).reshape(n, 256)
    f = normalise(counts)
    # an empty row codes nothing under the uniform table
    c = np.cumsum(f, axis=1) - f
    state = np.full((n, LANES), LOWER, np.int64)
    words = np.zeros((turns, n, LANES), np.uint16)
    sent = np.zeros((turns, n, LANES), bool)
    row = np.arange(n)[:, None]
    by_turn, used_turn = padded.reshape(n, turns, LANES), used.reshape(n, turns, LANES)
    for t in range(turns - 1, -1, -1):
        symbol, live = by_turn[:, t], used_turn[:, t]
        own, base = f[row, symbol], c[row, symbol]
        full = live & (state >= own << (16 + 16 - SCALE_BITS))
        words[t], sent[t] = state & 0xFFFF, full
        state = np.where(full, state >> 16, state)
        safe = np.maximum(own, 1)
        state = np.where(live, (state // safe << SCALE_BITS) + state % safe + base, state)
    lane_words = sent.sum(axis=0)
    by_row = words.transpose(1, 2, 0)[sent.transpose(1, 2, 0)]  # row, lane, then forward in time, as a decoder reads
    ends = np.cumsum(lane_words.sum(axis=1))
    table = np.zeros((n, LANES, 2), "<u4")
    table[:, :, 0], table[:, :, 1] = state, lane_words
    out = []
    for i in range(n):
        active = np.flatnonzero(f[i])
        entries = np.zeros(len(active), np.dtype([("s", "u1"), ("f", "<u2")]))
        entries["s"], entries["f"] = active, f[i, active]
        out.append(struct.pack("<IQH", MAGIC, int(length[i]), len(active)) + entries.tobytes() + table[i].tobytes() + by_row[ends[i - 1] if i else 0 : ends[i]].astype("<u2").tobytes())
    return out


def decode(payloads: list[bytes], expected: np.ndarray | None, most: np.ndarray) -> list[np.ndarray]:
    """The bytes of each payload; ``expected`` counts if they are known, ``most`` in any case."""
    n = len(payloads)
    f = np.zeros((n, 256), np.int64)
    count = np.zeros(n, np.int64)
    state = np.zeros((n, LANES), np.int64)
    lane_words = np.zeros((n, LANES), np.int64)
    bodies = []
    for i, p in enumerate(payloads):
        if len(p) < 14:
            raise CorruptedStream("truncated entropy payload")
        magic, total, active = struct.unpack_from("<IQH", p)
        if magic != MAGIC:
            raise CorruptedStream("bad entropy magic")
        if expected is not None and total != expected[i] or total > most[i]:
            raise CorruptedStream("entropy symbol count mismatch")
        at = 14 + 3 * active
        if not 1 <= active <= 256 or len(p) < at + 8 * LANES:
            raise CorruptedStream("invalid entropy alphabet")
        entries = np.frombuffer(p, np.dtype([("s", "u1"), ("f", "<u2")]), active, 14)
        f[i, entries["s"]] = entries["f"]
        # a symbol that comes twice, or with no frequency, leaves fewer than there are entries
        if np.count_nonzero(f[i]) != active or int(entries["f"].sum(dtype=np.int64)) != SCALE:
            raise CorruptedStream("invalid entropy frequencies")
        lanes = np.frombuffer(p, "<u4", 2 * LANES, at).reshape(LANES, 2)
        state[i], lane_words[i], count[i] = lanes[:, 0], lanes[:, 1], total
        body = p[at + 8 * LANES :]
        if 2 * int(lane_words[i].sum()) != len(body):
            raise CorruptedStream("entropy words do not fill the payload")
        bodies.append(body)
    pool = np.frombuffer(b"".join(bodies) + b"\0\0", "<u2").astype(np.int64)
    flat = lane_words.ravel()
    stop = np.cumsum(flat).reshape(n, LANES)
    at = stop - lane_words
    # by slot: its symbol, the symbol's frequency, and the slot's place within the symbol's
    symbols = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), f.ravel())
    width = np.repeat(f.ravel(), f.ravel()).astype(np.int32)
    place = (np.tile(np.arange(SCALE), n) - np.repeat((np.cumsum(f, axis=1) - f).ravel(), f.ravel())).astype(np.int32)
    turns = -(-int(count.max()) // LANES) if n else 0
    out = np.zeros((turns, n, LANES), np.uint8)
    base = np.arange(n)[:, None] * SCALE
    lane = np.arange(LANES)
    whole = int(count.min()) // LANES if n else 0
    for t in range(turns):
        slot = base + (state & (SCALE - 1))
        symbols.take(slot, out=out[t])
        new = width.take(slot) * (state >> SCALE_BITS) + place.take(slot)
        live = True if t < whole else t * LANES + lane < count[:, None]
        low = (new < LOWER) & live
        if (low & (at >= stop)).any():
            raise CorruptedStream("entropy words run out")
        new = np.where(low, (new << 16) | pool.take(at, mode="clip"), new)
        if ((new < LOWER) & live).any():
            raise CorruptedStream("entropy words run out")
        at = at + low
        state = new if live is True else np.where(live, new, state)
    if (state != LOWER).any() or (at != stop).any():
        raise CorruptedStream("entropy states do not end as they began")
    out = out.transpose(1, 0, 2)
    flat_out = out.reshape(n, -1)
    return [flat_out[i, : count[i]] for i in range(n)]
