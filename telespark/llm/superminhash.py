"""SuperMinHash signatures of many sets at once.

An element throws one value into each of the slots, in the order of a permutation of its own: the j-th
throw is j plus a random fraction. A slot keeps its least value. All sets take their j-th throws together; a set stops once every slot
is filled and no value so far reaches the next throw, since no later throw can then win. A set of n elements needs about
m ln(m) / n throws of each, so signatures of long texts cost a few numpy passes over their elements.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, stream64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, bounds: np.ndarray, slots: int, most: int = 150_000) -> np.ndarray:
    """A row of ``slots`` values per set; EMPTY in all slots of an empty set."""
    n = np.diff(bounds)
    out = np.full((len(n), slots), EMPTY, np.uint64)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    sizes = np.cumsum(n[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        some = order[at:stop]
        own = n[some]
        index = np.repeat(bounds[some] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        out[some] = _throw(elements[index], np.repeat(np.arange(len(some)), own), len(some), slots)
        at = stop
    return out


def _throw(x: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    made = np.full(sets * slots, EMPTY, np.uint64)
    rows = made.reshape(sets, slots)
    swaps: list[np.ndarray] = []
    salts = np.arange(1, slots + 1, dtype=np.uint64) * _GOLD
    for j in range(slots):
        h = mix64(x + salts[j])
        pick = (np.uint64(j) + (((h & _LOW) * np.uint64(slots - j)) >> _HALF)).astype(np.int16)
        # the permutation's j-th place: follow the earlier swaps back from the place picked
        place = pick.copy()
        for i in range(j - 1, -1, -1):
            place[swaps[i] == place] = i
        value = (np.uint64(j) << _HALF) | (h >> _HALF)
        np.minimum.at(made, owner * slots + place, value)
        live = rows.max(axis=1) >= np.uint64(j + 1) << _HALF
        if not live.any():
            break
        swaps.append(pick)
        keep = live[owner]
        if np.count_nonzero(keep) < 0.8 * len(x):
            x, owner = x[keep], owner[keep]
            swaps = [s[keep] for s in swaps]
    return rows


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of equally many slots; the band's number is in the key."""
    sets, slots = signature.shape
    rows = slots // bands
    by = signature[:, : bands * rows].reshape(sets, bands, rows)
    weights = stream64(rows, 3) | np.uint64(1)
    return mix64((mix64(by) * weights).sum(axis=2, dtype=np.uint64) + stream64(bands, 4))


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each slot, packed into uint64 columns: the share of unlike bits estimates half the distance."""
    h = mix64(signature)
    bits = np.stack([h & np.uint64(1), (h >> np.uint64(1)) & np.uint64(1)], axis=2).reshape(len(signature), -1).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed.view(np.uint64)
