"""Predictors of blocks held as rows of a matrix."""

from __future__ import annotations

import numpy as np

from ..config import CONSTANT, HARMONIC, LINEAR, WINDOW


def choose(x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictor and harmonic coefficient of each row, from its first samples' autocorrelation."""
    head = x[:, :WINDOW].astype(float)
    width = np.minimum(count, WINDOW)
    valid = np.arange(head.shape[1]) < width[:, None]
    n = np.maximum(width, 1)
    c = np.where(valid, head - (np.where(valid, head, 0).sum(axis=1) / n)[:, None], 0.0)
    energy = (c * c).sum(axis=1)
    safe = np.where(energy > 0, energy, 1.0)
    r1 = (c[:, 1:] * c[:, :-1]).sum(axis=1) / safe
    r2 = (c[:, 2:] * c[:, :-2]).sum(axis=1) / safe
    still = (energy / n < 1e-9) | (energy == 0) | (np.abs(r1) < 0.25)
    tone = ~still & (2 * (1 - r1 * r1) > 1e-4) & (r2 < 0.95 * r1)
    pole = np.clip(r1 * (1 + r2) / (2 * r2 + 1e-5), -0.999, 0.999).astype(np.float32)
    if x.shape[1] >= 3:
        raw = x[:, :WINDOW]
        ok = valid[:, 2:]
        middle = raw[:, 1:-1].astype(float)
        both = (raw[:, 2:] + raw[:, :-2]).astype(float)
        up = np.where(ok, middle * both, 0).sum(axis=1)
        down = np.where(ok, 2 * middle * middle, 0).sum(axis=1)
        again = (np.abs(pole) >= np.float32(0.9989)) & (width >= 3) & (down > 1e-20)
        pole = np.where(again, np.clip(up / np.where(again, down, 1.0), -0.999, 0.999).astype(np.float32), pole)
    mode = np.where(still, CONSTANT, np.where(tone, HARMONIC, LINEAR)).astype(np.int8)
    return mode, np.where(tone, pole, np.float32(0)).astype(np.float32)


def weights(mode: np.ndarray, pole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step's prediction is first * previous - second * the one before, in float32."""
    two = np.float32(2)
    first = np.where(mode == HARMONIC, two * pole, np.where(mode == LINEAR, two, np.float32(1))).astype(np.float32)
    return first, np.where(mode == CONSTANT, np.float32(0), np.float32(1)).astype(np.float32)


def step(i: int, first: np.ndarray, second: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Predictions of sample i of all rows; sample 0 predicts 0 and sample 1 the sample before it."""
    if i == 0:
        return np.zeros_like(last)
    return last.copy() if i == 1 else first * last - second * before


def residuals(x: np.ndarray, mode: np.ndarray, pole: np.ndarray) -> np.ndarray:
    """Differences from predictions by true history."""
    first, second = weights(mode, pole)
    out = x.copy()
    out[:, 1:2] -= x[:, :1]
    out[:, 2:] -= first[:, None] * x[:, 1:-1] - second[:, None] * x[:, :-2]
    return out


def reconstruct(r: np.ndarray, mode: np.ndarray, pole: np.ndarray) -> np.ndarray:
    """Samples from residuals."""
    first, second = weights(mode, pole)
    out = np.empty_like(r)
    last = before = np.zeros(len(r), np.float32)
    for i in range(r.shape[1]):
        out[:, i] = step(i, first, second, last, before) + r[:, i]
        last, before = out[:, i], last
    return out
