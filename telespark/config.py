"""Codec settings and the fixed values of the data model."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed values of the wire format and the model.
BLOCK = 2048
WINDOW = 64
LANES = 16
SCALE_BITS = 12
SCALE = 1 << SCALE_BITS
LOWER = 1 << 16
HEADER_BYTES = 64
RECORD_FIXED = 36
BODY_FIXED = 28
MAX_BODY = 16 << 20
MAX_BUFFER = 256 << 20
MAX_SAMPLES = 64 << 20
CONSTANT, HARMONIC, LINEAR = 0, 1, 2
RATE_MODE, ERROR_MODE = 0, 1
BETA_MIN, BETA_MAX, RATIO_POINTS = 0.2, 5.0, 4097
LEAST_RECORD = 256


@dataclass(frozen=True)
class CodecConfig:
    """target_rate in bits per sample, or a pointwise bound if absolute_error is positive."""

    target_rate: float = 4.0
    absolute_error: float = 0.0
    deadzone: float = 0.3
    enable_index: bool = False
    adaptive_tail: bool = True

    def __post_init__(self) -> None:
        if not (math.isfinite(self.target_rate) and 2.0 <= self.target_rate <= 8.0):
            raise ValueError("target rate must be finite and in [2, 8]")
        if not (math.isfinite(self.deadzone) and self.deadzone >= 0):
            raise ValueError("dead zone must be finite and non-negative")
        if not (math.isfinite(self.absolute_error) and self.absolute_error >= 0):
            raise ValueError("absolute error must be finite and non-negative")

    @property
    def error_bounded(self) -> bool:
        return self.absolute_error > 0


def align64(n: int) -> int:
    return -(-n // 64) * 64


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def nominal_levels(rate: float) -> int:
    return min(256, max(4, round_half_up(2.0**rate)))
