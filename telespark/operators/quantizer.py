"""Scalar quantizers fitted to the residuals they will code, for many blocks at once.

A quantizer has a zero cell around 0 and as many cells on either side, all of one step, with the mean of what falls into a cell as its level. With an
entropy coder behind it, that is within a tenth of a bit of the best scalar quantizer at the rates in use, and it has one number to search
for. Blocks with rare large residuals may give their outermost cells geometrically growing widths up to the largest residual.

Everything is worked out from sorted residuals and their prefix sums: the count and the sum of any cell are two look-ups, so a
trial costs a binary search per boundary. Rows are blocks; a block with fewer cells than the widest is padded on the right with
boundaries at infinity.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from ..functions.shape import deviation

IMPULSIVE_BETA, IMPULSIVE_PEAK = 0.8, 8.0
#: Halvings of the interval of steps, which spans TRIED octaves below twice the largest residual.
HALVINGS, TRIED = 11, 18
WIDER = (1.0, 1.12, 1.3, 1.6)
#: Cells in relation to 2 ** rate that are tried, and the shares of a side's cells that may be tail cells.
SHARES, TAILS = (0.5, 0.75, 1.0, 1.5, 1.8, 2.5), (0.0, 0.12, 0.25, 0.5)


class Design(NamedTuple):
    bounds: np.ndarray  # [block, K - 1] inner boundaries, rising
    levels: np.ndarray  # [block, K] by cell
    cells: np.ndarray  # [block] cells in use, odd; the middle one is the zero cell

    def rows(self, keep: np.ndarray) -> Design:
        return Design(*(x[keep] for x in self))


def widened(made: Design, k: int) -> Design:
    """The same, with room for k cells a row."""
    more = k - made.levels.shape[1]
    return Design(np.pad(made.bounds, ((0, 0), (0, more)), constant_values=np.inf), np.pad(made.levels, ((0, 0), (0, more))), made.cells)


def symbols_of_cells(k: int) -> np.ndarray:
    """The symbol of each of k cells: the zero cell is 0, the cells below it 1 and on."""
    return cell_symbols(np.arange(k), np.int64(k))


def cell_symbols(cell: np.ndarray, k: np.ndarray) -> np.ndarray:
    middle = k // 2
    return np.where(cell == middle, 0, np.where(cell < middle, cell + 1, cell))


def quantize(v: np.ndarray, bounds: np.ndarray, lower_ties: bool = False) -> np.ndarray:
    """Cells of values by a code book's rising boundaries; a value on a boundary goes up, or down (lower_ties)."""
    return np.searchsorted(bounds, v, side="left" if lower_ties else "right")


def is_impulsive(alpha: np.ndarray, beta: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return (beta < IMPULSIVE_BETA) & (peak > IMPULSIVE_PEAK * deviation(alpha, beta))


class Sorted:
    """Rows of values, sorted, with prefix sums: counts and sums of cells by binary search."""

    def __init__(self, values: np.ndarray, reach: float = 1.0) -> None:
        """``reach``: how far beyond the largest value tail cells are to be spread."""
        v = np.sort(values.astype(float), axis=1)
        self.size = v.shape[1]
        self.peak = np.maximum(-v[:, 0], v[:, -1])
        self.scale = np.where(self.peak > 0, self.peak, 1.0)
        # one sorted list of all rows: each row lies in a unit interval of its own
        self.flat = self._place(v / self.scale[:, None]).ravel()
        self.sums = np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, axis=1)], axis=1)
        self.power = (v * v).sum(axis=1)
        self.peak = self.peak * reach

    @staticmethod
    def _place(v: np.ndarray) -> np.ndarray:
        return np.clip(v, -1.5, 1.5) / 4 + 0.5 + np.arange(len(v))[:, None]

    def cells(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the cells between rising boundaries."""
        n = len(bounds)
        with np.errstate(invalid="ignore"):
            at = np.searchsorted(self.flat, self._place(bounds / self.scale[:, None]).ravel(), side="left").reshape(n, -1) - np.arange(n)[:, None] * self.size
        at = np.concatenate([np.zeros((n, 1), np.int64), np.clip(at, 0, self.size), np.full((n, 1), self.size)], axis=1)
        return np.diff(at, axis=1), np.diff(np.take_along_axis(self.sums, at, axis=1), axis=1)


def boundaries(step: np.ndarray, k: int, zone: float, tail: int, peak: np.ndarray) -> np.ndarray:
    """Inner boundaries of k cells of a step each, the zero cell wider by the share ``zone``; the outermost ``tail`` cells reach the peak."""
    side = k // 2
    upper = (0.5 * (1 + zone) + np.arange(side))[None, :] * step[:, None]
    if tail:
        begin = upper[:, side - tail]
        growth = np.maximum(peak / np.maximum(begin, 1e-300), 1.0) ** (1 / tail)
        upper[:, side - tail :] = begin[:, None] * growth[:, None] ** np.arange(tail)[None, :]
    return np.concatenate([-upper[:, ::-1], upper], axis=1)


def levels_of(bounds: np.ndarray, step: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means of the cells; middles where nothing falls into one, and 0 for the zero cell."""
    half = 0.5 * step[:, None]
    ends = np.concatenate([bounds[:, :1] - 2 * half, bounds, bounds[:, -1:] + 2 * half], axis=1)
    out = np.where(count > 0, total / np.maximum(count, 1), 0.5 * (ends[:, 1:] + ends[:, :-1]))
    out[:, out.shape[1] // 2] = 0
    return out


class Cost(NamedTuple):
    bytes: np.ndarray
    loss: np.ndarray


def cost(data: Sorted, bounds: np.ndarray, fixed: np.ndarray) -> tuple[Cost, np.ndarray, np.ndarray]:
    """Estimated bytes (``fixed``, seven for each level in use, and the entropy) and squared error, with the cells' counts and sums."""
    count, total = data.cells(bounds)
    share = count / data.size
    bits = -(count * np.log2(np.where(count > 0, share, 1.0))).sum(axis=1)
    gain = np.where(count > 0, total * total / np.maximum(count, 1), 0.0)
    gain[:, gain.shape[1] // 2] = 0
    size = fixed + 4 * count.shape[1] + 3 * (count > 0).sum(axis=1) + bits / 8
    return Cost(size, data.power - gain.sum(axis=1)), count, total


def cell_counts(rate: float) -> list[int]:
    """Odd numbers of cells that are tried at a rate."""
    return sorted({min(255, max(5, int(share * 2**rate) | 1)) for share in SHARES})


def fitted(data: Sorted, room: np.ndarray, k: int, zone: float, tail: int, fixed: np.ndarray) -> tuple[Design, Cost]:
    """The design of k cells with the least step whose estimated bytes are within ``room``."""
    top = 2 * data.scale
    low, high = np.log2(top) - TRIED, np.log2(top)
    for _ in range(HALVINGS):
        middle = 0.5 * (low + high)
        found, _, _ = cost(data, boundaries(2.0**middle, k, zone, tail, data.peak), fixed)
        ok = found.bytes <= room
        low, high = np.where(ok, low, middle), np.where(ok, middle, high)
    # with few cells a wider step may lose less, since less lies beyond the outermost boundaries
    step, least = 2.0**high, None
    for wider in WIDER:
        near, _, _ = cost(data, boundaries(wider * 2.0**high, k, zone, tail, data.peak), fixed)
        better = (near.bytes <= room) & (near.loss < least) if least is not None else np.ones(len(high), bool)
        step, least = np.where(better, wider * 2.0**high, step), np.where(better, near.loss, np.inf if least is None else least)
    bounds = boundaries(step, k, zone, tail, data.peak)
    found, count, total = cost(data, bounds, fixed)
    with np.errstate(over="ignore"):
        return Design(bounds.astype(np.float32), levels_of(bounds, step, count, total).astype(np.float32), np.full(len(step), k)), found


def best_of(data: Sorted, room: np.ndarray, rate: float, zone: float, tails: tuple[float, ...], fixed: np.ndarray) -> tuple[Design, Cost]:
    """Each row's design of least estimated loss among those that fit its room, or else the smallest; and its estimated cost."""
    tried = [fitted(data, room, k, zone, t, fixed) for k in cell_counts(rate) for t in sorted({math.ceil(share * (k // 2)) for share in tails}) if t < k // 2]
    widest = max(d.levels.shape[1] for d, _ in tried)
    score = np.stack([np.where(c.bytes <= room, c.loss, np.inf) for _, c in tried])
    size = np.stack([c.bytes for _, c in tried])
    pick = np.where(np.isfinite(score).any(axis=0), np.argmin(score, axis=0), np.argmin(size, axis=0))
    wide = [widened(d, widest) for d, _ in tried]
    row = np.arange(len(pick))
    stacked = [np.stack([d[i] for d in wide]) for i in range(3)]
    return Design(*(x[pick, row] for x in stacked)), Cost(size[pick, row], np.stack([c.loss for _, c in tried])[pick, row])


def silent(n: int) -> Design:
    """All values in the zero cell."""
    bounds = np.tile(np.float32([-np.inf, -np.inf, np.inf, np.inf]), (n, 1))
    return Design(bounds, np.zeros((n, 5), np.float32), np.full(n, 5))


class CodeBook:
    """One quantizer by itself, to study or to use apart from blocks: fitted to given values by Lloyd's rule with an entropy term.

    Boundaries lie where two levels cost the same: half-way, moved towards the rarer one by weight / gap times the difference of their code
    lengths. Levels are the means of their cells. ``weight`` 0 gives the least squared error for the number of cells.
    """

    def __init__(self, values: np.ndarray, cells: int, weight: float = 0.0, rounds: int = 60) -> None:
        v = np.sort(np.asarray(values, float).ravel())
        if not 2 <= cells <= 256 or not len(v) or not np.isfinite(v).all():
            raise ValueError("finite values and 2 to 256 cells are needed")
        sums = np.concatenate(([0.0], np.cumsum(v)))
        levels = np.quantile(v, (np.arange(cells) + 0.5) / cells)
        length = np.full(cells, np.log2(cells))
        for _ in range(rounds):
            gap = np.maximum(np.diff(levels), 1e-300)
            bounds = np.maximum.accumulate(0.5 * (levels[1:] + levels[:-1]) + weight / (2 * gap) * np.diff(length) * (np.diff(levels) > 0))
            at = np.concatenate(([0], np.searchsorted(v, bounds, side="left"), [len(v)]))
            count = np.diff(at)
            new = np.where(count > 0, np.diff(sums[at]) / np.maximum(count, 1), levels)
            length = np.log2(len(v) / np.maximum(count, 0.5))
            if np.array_equal(new, levels):
                break
            levels = np.maximum.accumulate(new)
        self.bounds, self.levels = bounds, levels

    def quantize(self, values: np.ndarray, lower_ties: bool = False) -> np.ndarray:
        return quantize(np.asarray(values, float), self.bounds, lower_ties)

    def dequantize(self, cells: np.ndarray) -> np.ndarray:
        return self.levels[cells]

    def polynomial(self, degree: int = 5) -> np.ndarray:
        """Coefficients, lowest power first, of the least-squares polynomial through (boundary, cell): a smooth stand-in for the search."""
        if len(self.bounds) < 2:
            raise ValueError("a polynomial needs two boundaries")
        return np.polynomial.polynomial.polyfit(self.bounds, np.arange(1, len(self.levels)), min(degree, len(self.bounds) - 1))

    def polynomial_cell(self, values: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        """Cells by the polynomial, exact beside a boundary: its guess is moved by what the two boundaries around it say."""
        v = np.clip(np.asarray(values, float), self.bounds[0], self.bounds[-1])
        guess = np.clip(np.floor(np.polynomial.polynomial.polyval(v, coefficients)), 0, len(self.levels) - 1).astype(np.int64)
        edges = np.concatenate(([-np.inf], self.bounds, [np.inf]))
        low, high = np.asarray(values, float) < edges[guess], np.asarray(values, float) >= edges[guess + 1]
        return np.where(low | high, self.quantize(values), guess)
