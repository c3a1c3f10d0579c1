"""Operators: native statistics on DataFrames, and the block codec vectorised across blocks."""
