"""Connected components of an edge table, without an adjacency list in any one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one batch: each node with its least reachable one, so at most one edge per node."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))], np.int64)
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b: long, not null); root is the least id that it reaches.

    Edges are first cut to forests within Arrow batches (union-find), then stars are formed alternately towards larger and smaller
    neighbours until nothing moves. A node's neighbours are only ever reduced by min(), never listed, so a hub of any degree is one
    row per task.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = materialise(edges.mapInArrow(_forest, "a long, b long").distinct())  # a > b: b is a root
    seen = None
    while True:
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, check) == seen or not n:
            break
        seen = (n, check)
        # small star: every smaller neighbour of a node, and the node itself, to the least of them
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        # large star: every larger neighbour of a node to the least of the node and its neighbours
        both = small.union(small.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        new = materialise(large)
        discard(now)
        now = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
