"""Scalar functions: checksums, variable-length integers, special functions."""
