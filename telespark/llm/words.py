"""Words of whole columns of text as 64-bit hashes, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import mix64, stream64

#: Byte classes.
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream64(256, 1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _STEP)])
    return _POWERS[:n]


class Words(NamedTuple):
    hashes: np.ndarray  # one per word, texts in a row
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]


def hashed_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, beginnings: tuple[int, ...] = ()) -> Words:
    """A-Z lower-cased words between separators. Equal words have equal hashes; others differ but for 64-bit chance.

    For each number of bytes in ``beginnings``, the hash of a longer word's first bytes follows the word's own.
    """
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    gap = separators[data]
    first = ~gap
    first[1:] &= gap[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = ~gap[inner]  # a text's first byte begins a word, whatever the text before ended with
    start = np.flatnonzero(first)
    kept = np.flatnonzero(~gap)
    begin = np.searchsorted(kept, start)
    length = np.diff(begin, append=len(kept))
    if not len(start):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    nth = np.arange(len(kept)) - np.repeat(begin, length)
    value = _BYTE[_LOWER[data[kept]]] * powers(int(length.max()))[nth]
    bounds = np.searchsorted(start, offsets)
    whole = mix64(np.add.reduceat(value, begin) + length.astype(np.uint64))
    if not beginnings:
        return Words(whole, bounds)
    made = np.zeros((len(whole), 1 + len(beginnings)), np.uint64)
    made[:, 0] = whole
    for i, n in enumerate(beginnings, 1):
        made[:, i] = np.where(length > n, mix64(np.add.reduceat(value * (nth < n), begin) + np.uint64(1 << 32 | n)), whole)
    return Words(made.ravel(), bounds * (1 + len(beginnings)))


_MULTIPLIERS = stream64(64, 2) | np.uint64(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, in a row, and their bounds. Fewer words than ``size`` are one shingle; none, none."""
    h, bounds = words
    n = np.diff(bounds)
    total = len(h)
    value = np.zeros(total, np.uint64)
    for j in range(min(size, total)):
        value[: total - j] += h[j:] * _MULTIPLIERS[j]
    value = mix64(value)
    short = np.flatnonzero((n > 0) & (n < size))
    for i in short.tolist():
        own = h[bounds[i] : bounds[i + 1]]
        value[bounds[i]] = mix64((own * _MULTIPLIERS[: len(own)]).sum(keepdims=True) + _MULTIPLIERS[[32 + len(own) % 32]])[0]
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    sets = [np.unique(value[a : a + c]) for a, c in zip(bounds[:-1].tolist(), count.tolist(), strict=True)]
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends
