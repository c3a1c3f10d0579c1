"""Operators of a training-data pipeline over tables of documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
