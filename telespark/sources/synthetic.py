"""Synthetic traces as column functions of the sample's number, the same on every run and partitioning.

A trace is a Recipe: tones that may decay, noise, a slow wander, and rare shocks. RECIPES has one for each kind of signal that a codec
of telemetry meets; any number in them can be replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_sum

_UNIT = 1 << 30


class Tone(NamedTuple):
    hertz: float
    size: float = 1.0
    #: Seconds after which it has lost two thirds of its size; None: never.
    fades: float | None = None


class Recipe(NamedTuple):
    per_second: float = 1000.0
    tones: tuple[Tone, ...] = ()
    noise: float = 0.0
    #: Standard deviation of one step of a random walk.
    wander: float = 0.0
    #: One sample in so many is off by up to ``shock``.
    shock_every: int = 0
    shock: float = 0.0
    #: Every so many samples the noise is so many times as strong.
    burst_every: int = 0
    burst: float = 1.0


RECIPES = {
    "resonant": Recipe(tones=(Tone(20.0), Tone(64.0, 0.5), Tone(110.0, 0.25, 10.0)), noise=0.005),
    "sparse-shock": Recipe(noise=0.0005, shock_every=2000, shock=10.0),
    "drift": Recipe(tones=(Tone(0.05, 0.2),), noise=0.0005, wander=0.0002),
    "seismic": Recipe(per_second=50.0, tones=(Tone(1.25, 1.0, 900.0),), noise=0.004, wander=0.0001),
    "strain": Recipe(per_second=10.0, tones=(Tone(0.001, 0.05),), noise=0.0002, shock_every=8000, shock=1.5),
    "impulsive": Recipe(noise=1.0, burst_every=800, burst=20.0),
}
KINDS = tuple(RECIPES)


def uniform(index: Column, seed: int) -> Column:
    """In (0, 1), by a hash of the index."""
    return (F.pmod(F.xxhash64(index, F.lit(seed)), F.lit(_UNIT)) + 0.5) / float(_UNIT)


def normal(index: Column, seed: int, deviation: float | Column) -> Column:
    return F.sqrt(-2.0 * F.ln(uniform(index, seed))) * F.cos(2 * math.pi * uniform(index, seed + 1)) * deviation


def trace(spark: SparkSession, kind: str, count: int, seed: int = 1, recipe: Recipe | None = None) -> DataFrame:
    """(series_id, sample_idx, value) by a recipe, or that of one of KINDS."""
    made = recipe or RECIPES.get(kind)
    if made is None:
        raise ValueError(f"unknown kind {kind}")
    rows = spark.range(count).select(F.lit(kind).alias("series_id"), F.col("id").alias("sample_idx"))
    i = F.col("sample_idx")
    seconds = i / made.per_second
    value = F.lit(0.0)
    for tone in made.tones:
        wave = tone.size * F.sin(2 * math.pi * tone.hertz * seconds)
        value = value + (wave if tone.fades is None else wave * F.exp(-seconds / tone.fades))
    if made.noise:
        strength = F.when(i % made.burst_every == 0, made.burst * made.noise).otherwise(made.noise) if made.burst_every else made.noise
        value = value + normal(i, seed, strength)
    if made.shock_every:
        value = value + F.when(uniform(i, seed + 2) * made.shock_every < 1, (2.0 * uniform(i, seed + 3) - 1.0) * made.shock).otherwise(0.0)
    if made.wander:
        rows = running_sum(rows.withColumn("_step", normal(i, seed + 4, made.wander)), "_step", "walk")
        value = value + F.col("walk")
    return rows.select("series_id", "sample_idx", value.cast("float").alias("value"))
