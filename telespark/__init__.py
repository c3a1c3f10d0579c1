"""Telemetry analytics on Spark: blocks of float32 series, their statistics, compression and random access."""

__version__ = "0.1.0"
