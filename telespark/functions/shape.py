"""Generalised error distributions: moment ratios, shape estimates, and cell masses by tabulated integrals."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from ..config import BETA_MAX, BETA_MIN, RATIO_POINTS

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
FLT_MIN = float(np.finfo(np.float32).tiny)


def moment_ratio(beta: np.ndarray | float) -> np.ndarray:
    """(E|x|)**2 / E x**2 of a distribution of this shape."""
    b = np.asarray(beta, float)
    return np.exp(2 * _LGAMMA(2 / b) - _LGAMMA(1 / b) - _LGAMMA(3 / b))


@lru_cache(maxsize=1)
def ratio_table() -> tuple[np.ndarray, np.ndarray]:
    beta = BETA_MIN + (BETA_MAX - BETA_MIN) * np.arange(RATIO_POINTS) / (RATIO_POINTS - 1)
    return moment_ratio(beta), beta


def shape_from_ratio(ratio: np.ndarray) -> np.ndarray:
    """The shape, interpolated between table points and clamped at the ends, as float32."""
    table, beta = ratio_table()
    return np.interp(ratio, table, beta).astype(np.float32)


def scale_from_variance(variance: np.ndarray, beta: np.ndarray) -> np.ndarray:
    b = np.asarray(beta, float)
    return np.sqrt(variance * np.exp(_LGAMMA(1 / b) - _LGAMMA(3 / b)))


def deviation(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    b = np.asarray(beta, float)
    return np.asarray(alpha, float) * np.exp(0.5 * (_LGAMMA(3 / b) - _LGAMMA(1 / b)))


def estimate(residuals: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta) of each row by moments; rows without variance are (0, 2)."""
    n = np.maximum(valid.sum(axis=1), 1)
    mean = (np.where(valid, residuals, 0).sum(axis=1, dtype=float) / n).astype(np.float32)
    c = np.where(valid, residuals - mean[:, None], np.float32(0)).astype(float)
    first, second = np.abs(c).sum(axis=1) / n, (c * c).sum(axis=1) / n
    flat = second <= FLT_MIN
    safe = np.where(flat, 1.0, second)
    beta = shape_from_ratio(np.clip(first * first / safe, 0, 1))
    alpha = scale_from_variance(safe, beta).astype(np.float32)
    return np.where(flat, np.float32(0), alpha), np.where(flat, np.float32(2), beta)


class Mass:
    """Half mass and half first moment of unit-scale distributions from 0 to t, one row per shape.

    Both are integrated once on an even grid of s = t**min(1, beta / 2), where they are smooth at the origin and in the tail, and then read off
    by cubic Hermite interpolation, since the integrands are their slopes.
    """

    NODES, REACH = 384, 36.0

    def __init__(self, beta: np.ndarray) -> None:
        b = np.asarray(beta, float)[:, None]
        self.power = np.minimum(1.0, b / 2)
        self.top = self.REACH ** (self.power / b)
        x, w = np.polynomial.legendre.leggauss(4)
        step = self.top / self.NODES
        mid = (np.arange(self.NODES) + 0.5)[None, :, None] + 0.5 * x[None, None, :]
        mass, moment = self._slopes(mid * step[:, :, None], b[:, :, None], self.power[:, :, None])
        gather = lambda f: np.concatenate([np.zeros((len(b), 1)), np.cumsum((f * w).sum(axis=2) * step / 2, axis=1)], axis=1)
        self.values = [gather(mass), gather(moment)]
        self.slopes = list(self._slopes(np.arange(self.NODES + 1)[None, :] * step, b, self.power))
        total = self.values[0][:, -1:] * 2
        self.values, self.slopes = [v / total for v in self.values], [s / total * step for s in self.slopes]

    @staticmethod
    def _slopes(s: np.ndarray, b: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = s ** (1 / power)
        density = np.exp(-(t**b)) * (1 / power) * np.where(power < 1, s ** (1 / power - 1), 1.0)
        return density, density * t

    def rows(self, keep: np.ndarray) -> Mass:
        out = object.__new__(Mass)
        out.power, out.top = self.power[keep], self.top[keep]
        out.values, out.slopes = [v[keep] for v in self.values], [s[keep] for s in self.slopes]
        return out

    def __call__(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mass and moment from 0 to each |t| (rows as the shapes); their signs follow t."""
        u = np.minimum(np.abs(t), 1e300) ** self.power / self.top * self.NODES
        at = np.minimum(u, self.NODES - 1).astype(np.int64)
        f = np.minimum(u - at, 1.0)
        row = np.arange(len(u))[:, None]
        h1 = f * f * (3 - 2 * f)
        d0, d1 = f * (1 - f) ** 2, f * f * (f - 1)
        out = []
        for v, s in zip(self.values, self.slopes, strict=True):
            a, b = v[row, at], v[row, at + 1]
            out.append(a + (b - a) * h1 + s[row, at] * d0 + s[row, at + 1] * d1)
        return np.sign(t) * out[0], out[1]
