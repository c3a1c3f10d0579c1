"""Operator 10, approximate nearest neighbours: multiprobe p-stable hashing.

Unit vectors are hashed in TABLES tables by Gaussian projections, floor((a.x + b) / width): among unit vectors the nearest by angle are
the nearest by distance. How wide a cell is and how many projections a table has follow the data: a bounded sample of queries is compared with all
rows once, which tells how far neighbours lie (the radius); the width is in proportion to it, and there are as many projections as leave
about FILL entries in a bucket.

A query visits buckets in order of estimated success: the probability that a neighbour at the radius falls into a cell, given where the
query lies in its own, is a product over the projections. It stops when the visited buckets of a table add up to SUCCESS. So close
neighbours cost few buckets, and far ones many.

Equal vectors are one entry with their ``neighbours + 1`` smallest ids, which is all that any answer can hold of them, so a vector that a third of the rows
share costs nothing. Index entries and probes meet by shards of buckets; a shard with more entries than SHARD is split by id, and its
queries go to each part. Every part reranks its candidates by exact cosine in double precision on the original vectors and keeps each
query's best; the tables' candidates merge in a last top-k. A query that met fewer rows than it asked for, and than there are, is compared
with all entries, dealt among tasks. Every row is indexed.

Recall and the share of rows visited, measured by report() against brute force, are in the README; uniform random vectors of many
dimensions, whose neighbours lie almost as far as all others, are the hardest case.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another dimension than the
commonest (the smaller, in ties); a null id takes no part; rows with one id count once for each different vector; fewer candidates than asked give
all; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least_ids, materialise, mix64, share_below, stream64

TABLES = 2
NEIGHBOURS = 5
#: Estimated share of a query's neighbours that one table's visited buckets hold.
SUCCESS = 0.76
#: Entries of a bucket, on average; projections of a table; cells' width in radii; and steps off the query's cell that one bucket may combine.
FILL, PROJECTIONS, WIDE, MOVED = 8, (2, 8), 2.0, 8
#: Queries whose neighbours are found exactly to learn the radius, and the share of their distances that lie below it.
SAMPLE, BELOW = 64, 0.6
SHARD = 4096
#: Queries that one task compares with all entries of its part.
SHORT = 1024
SEED = 20_011
#: Candidate pairs that are compared at once.
PAIRS = 40_000


class Hashing(NamedTuple):
    """What every executor needs to hash; its size doesn't follow the rows."""

    dimension: int
    projections: int
    radius: float

    @property
    def width(self) -> float:
        return WIDE * self.radius

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Projections [dimension, table, projection] and offsets [table, projection]."""
        rng = np.random.default_rng(SEED)
        return rng.normal(size=(self.dimension, TABLES, self.projections)), rng.uniform(0, self.width, (TABLES, self.projections))

    def positions(self, vectors: np.ndarray) -> np.ndarray:
        """In units of cells: [vector, table, projection]."""
        a, b = self.parts()
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return (np.tensordot(unit, a, 1) + b) / self.width

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, table]: each vector's own bucket."""
        return names(np.floor(self.positions(vectors)).astype(np.int64), np.arange(TABLES))

    def probes(self, vectors: np.ndarray, success: float = SUCCESS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, table, bucket) of all visits, each table's likeliest first."""
        f = self.positions(vectors)
        cell = np.floor(f)
        below, above = cell - f, cell + 1 - f
        spread = 1 / WIDE
        edge = [normal_below((below - 1) / spread), normal_below(below / spread), normal_below(above / spread), normal_below((above + 1) / spread)]
        chance = np.log(np.maximum(np.stack([edge[1] - edge[0], edge[2] - edge[1], edge[3] - edge[2]], axis=-1), 1e-12))
        steps = moves(self.projections)
        who, table, bucket = [], [], []
        for t in range(TABLES):
            total = sum(chance[:, t, i, :][:, steps[:, i] + 1] for i in range(self.projections))
            order = np.argsort(-total, axis=1)
            reached = np.cumsum(np.exp(np.take_along_axis(total, order, 1)), axis=1)
            taken = np.concatenate([np.ones((len(f), 1), bool), reached[:, :-1] < success], axis=1)
            q, nth = np.nonzero(taken)
            who.append(q)
            table.append(np.full(len(q), t))
            bucket.append(names(cell[q, t].astype(np.int64) + steps[order[q, nth]], t))
        return np.concatenate(who), np.concatenate(table), np.concatenate(bucket)


_ERF = np.vectorize(math.erf, otypes=[float])


def normal_below(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def moves(k: int) -> np.ndarray:
    """Steps of -1, 0 and 1 in k projections, at most MOVED of them not 0."""
    out = [np.zeros((1, k), np.int64)]
    for n in range(1, min(MOVED, k) + 1):
        signs = np.array(list(itertools.product((-1, 1), repeat=n)), np.int64)
        for at in itertools.combinations(range(k), n):
            some = np.zeros((len(signs), k), np.int64)
            some[:, at] = signs
            out.append(some)
    return np.concatenate(out)


_WEIGHTS = stream64(PROJECTIONS[1], 31).view(np.int64)


def names(cells: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """One 64-bit name for a table's cell."""
    with np.errstate(over="ignore"):
        return mix64((cells * _WEIGHTS[: cells.shape[-1]]).sum(axis=-1).view(np.uint64) + (np.asarray(table, np.uint64) << np.uint64(40))).view(np.int64)


def hashing(dimension: int, rows: int, distances: np.ndarray) -> Hashing:
    """The hashing for so many rows whose sampled neighbours lie at these distances."""
    radius = float(np.clip(np.quantile(distances, BELOW), 0.02, 1.5)) if len(distances) else 1.0
    bits = max(0.3, 0.5 * math.log2(2 * math.pi * math.e) - math.log2(WIDE * radius))  # entropy of a projection's cell
    return Hashing(dimension, int(np.clip(round(math.log2(max(rows, 2) / FILL) / bits), *PROJECTIONS)), radius)


def usable(df: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """id and v (doubles) of the rows that take part, and the dimension."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("v") == dimension), dimension


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def sampled_distances(entries: DataFrame, queries: np.ndarray, neighbours: int) -> np.ndarray:
    """Distances from these query vectors, scaled to length 1, to their nearest entries but equal ones: one pass over all entries."""
    if not len(queries):
        return np.zeros(0)
    dimension = queries.shape[1]
    unit = queries / lengths(queries)[:, None]

    def work(batches):
        best = np.full((len(unit), 0), -1.0)
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), dimension)
                near = unit @ (v / lengths(v)[:, None]).T
                near[near > 1 - 1e-12] = -1.0
                best = -np.sort(-np.concatenate([best, near], axis=1), axis=1)[:, :neighbours]
        if best.shape[1]:
            q = np.repeat(np.arange(len(unit)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.ravel())], names=["q", "s"])

    found = entries.select("v").mapInArrow(work, "q long, s double")
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("nth") <= neighbours)
    score = np.array([r[0] for r in top.select("s").collect()])
    return np.sqrt(np.maximum(0, 2 - 2 * score[score > -1]))


def compare(index: pa.Table, probes: pa.Table, dimension: int, keep: int) -> pa.Table:
    """The best candidates of each probing query in this part of the index, by exact cosine, and how many it was compared with."""
    out_q, out_e, out_s, out_n = [], [], [], []
    if index.num_rows and probes.num_rows:
        index, probes = index.combine_chunks(), probes.combine_chunks()
        name = index.column("bucket").to_numpy()
        order = np.argsort(name, kind="stable")
        name = name[order]
        vec = matrix(index.column("v").combine_chunks(), dimension)[order]
        entry = index.column("entry").to_numpy()[order]
        norm = lengths(vec)
        query = matrix(probes.column("v").combine_chunks(), dimension)
        query_norm = lengths(query)
        asked = probes.column("buckets").combine_chunks()
        owner = np.repeat(np.arange(probes.num_rows), np.diff(asked.offsets.to_numpy()))
        wanted = asked.flatten().to_numpy()
        lo, hi = np.searchsorted(name, wanted, "left"), np.searchsorted(name, wanted, "right")
        some = hi > lo
        owner, lo, hi = owner[some], lo[some], hi[some]
        qid = probes.column("qid").to_numpy()
        n = np.bincount(owner, weights=hi - lo, minlength=probes.num_rows).astype(np.int64)
        ends = np.searchsorted(owner, np.arange(probes.num_rows + 1))
        for q in np.flatnonzero(n).tolist():
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo[ends[q] : ends[q + 1]], hi[ends[q] : ends[q + 1]], strict=True)])
            best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
            for a in range(0, len(at), PAIRS):
                part = at[a : a + PAIRS]
                s = np.einsum("ij,j->i", vec[part], query[q]) / (norm[part] * query_norm[q])
                best_s, best_e = np.concatenate([best_s, s]), np.concatenate([best_e, entry[part]])
                first = np.lexsort((best_e, -best_s))[:keep]
                best_s, best_e = best_s[first], best_e[first]
            out_q.append(np.full(len(best_s), qid[q]))
            out_e.append(best_e)
            out_s.append(best_s)
            out_n.append(np.r_[len(at), np.zeros(len(best_s) - 1, np.int64)])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.table({"qid": join(out_q, np.int64), "entry": join(out_e, np.int64), "score": join(out_s, float), "compared": join(out_n, np.int64)})


def nearest(df: DataFrame, every: int, neighbours: int = NEIGHBOURS, success: float = SUCCESS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id ``every`` divides, the nearest other rows found."""
    rows, dimension = usable(df, vector, key)
    spark = df.sparkSession
    if not dimension:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.distinct()
    # equal vectors: a window limit keeps the smallest ids of each before the shuffle already; an entry is named by its smallest
    held = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= neighbours + 1)
    entries = materialise(held.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "v"))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), "v")
    total = entries.count()
    some = least_ids(-(-total // every), SAMPLE, lambda share: queries.select(F.col("qid").alias("id")).where(share_below(F.col("qid"), share)))
    taken = [r["v"] for r in queries.where(F.col("qid").isin(some)).select("v").limit(4 * SAMPLE).collect()] if some else []
    made = hashing(dimension, total, sampled_distances(entries, np.array(taken, float).reshape(-1, dimension), neighbours))
    shards = max(1, total // SHARD)

    def index_rows(batches):
        for b in batches:
            if b.num_rows:
                flat = made.home(matrix(b.column("v"), dimension)).ravel()
                row = np.repeat(np.arange(b.num_rows), TABLES)
                shard = np.tile(np.arange(TABLES), b.num_rows) * shards + (flat.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(flat), b.column("entry").take(pa.array(row)), b.column("v").take(pa.array(row))], names=["shard", "bucket", "entry", "v"])

    def probe_rows(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                who, table, bucket = made.probes(matrix(part.column("v"), dimension), success)
                shard = table * shards + (bucket.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((shard, who))
                who, shard, bucket = who[order], shard[order], bucket[order]
                first = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(shard) != 0)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(who)].astype(np.int32)), pa.array(bucket))
                row = pa.array(who[first])
                yield pa.RecordBatch.from_arrays([pa.array(shard[first]), part.column("qid").take(row), part.column("v").take(row), lists], names=["shard", "qid", "v", "buckets"])

    index = materialise(entries.select("entry", "v").mapInArrow(index_rows, "shard long, bucket long, entry long, v array<double>"))
    parts = index.groupBy("shard").count().select("shard", F.ceil(F.col("count") / (2 * SHARD)).cast("int").alias("parts"))
    dealt = index.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts"))).select("shard", "part", "bucket", "entry", "v")
    asked = queries.mapInArrow(probe_rows, "shard long, qid long, v array<double>, buckets array<long>").join(parts, "shard")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", F.col("part").cast("long").alias("part"), "qid", "v", "buckets")
    answers = lambda index, asked, keep: index.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(lambda i, q: compare(i, q, dimension, keep), "qid long, entry long, score double, compared long")

    def ranked(found: DataFrame, keep: int) -> DataFrame:
        """Each query's best entries over all tables; then their rows, the query's own left out."""
        by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "entry")
        best = found.select("qid", "entry", "score").distinct().withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= keep).select("qid", "entry", "score")
        members = best.join(entries.select("entry", "ids"), "entry").select("qid", F.explode("ids").alias("vec_id"), "score").where("vec_id <> qid")
        rows = members.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))
        return rows.where(F.col("rank") <= neighbours).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    probed = materialise(ranked(answers(dealt, asked, neighbours + 1), neighbours + 1))
    # queries that met fewer rows than they ask for, of those there are beside their own
    there = entries.agg(F.sum(F.size("ids"))).first()[0]
    met = probed.groupBy(F.col("query_id").alias("qid")).agg(F.count("*").alias("met"))
    owned = queries.groupBy("qid").agg(F.count("*").alias("own"))
    lacking = owned.join(met, "qid", "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(neighbours), F.lit(there) - F.col("own"))).select("qid", "own")
    lacking = materialise(lacking)
    n, own = lacking.agg(F.count("*"), F.max("own")).first()
    if not n:
        return probed
    blocks, split = -(-n // SHORT), -(-total // (2 * SHARD))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("shard")
    short = queries.join(lacking.select("qid"), "qid").select(block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))).alias("part"), "qid", "v", F.array(F.lit(0).cast("long")).alias("buckets"))
    every_entry = entries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("entry"), F.lit(split)).alias("part"), F.lit(0).cast("long").alias("bucket"), "entry", "v")
    whole = ranked(answers(every_entry, short, neighbours + own), neighbours + own)
    return probed.join(lacking.select(F.col("qid").alias("query_id")), "query_id", "left_anti").select(whole.columns).union(whole)


class Report(NamedTuple):
    projections: int
    radius: float
    recall: float
    #: Cosines, and different rows among them, as shares of all rows, a query.
    compared: float
    distinct: float
    visits: float


def report(vectors: np.ndarray, queries: np.ndarray, neighbours: int = NEIGHBOURS, success: float = SUCCESS) -> Report:
    """What the same hashing gives for rows in memory, against brute force; ``queries`` are rows' numbers."""
    unit = vectors / lengths(vectors)[:, None]

    def exact(q: int) -> np.ndarray:
        s = unit @ unit[q]
        s[q] = -2
        return np.lexsort((np.arange(len(s)), -s))[:neighbours]

    truth = {int(q): exact(int(q)) for q in queries}
    some = list(truth)[:SAMPLE]
    far = np.concatenate([np.sqrt(np.maximum(0, 2 - 2 * (unit[truth[q]] @ unit[q]))) for q in some])
    made = hashing(vectors.shape[1], len(vectors), far)
    home = made.home(vectors)
    order = [np.argsort(home[:, t], kind="stable") for t in range(TABLES)]
    hit = pairs = distinct = visits = 0
    for q, want in truth.items():
        _, table, bucket = made.probes(vectors[q : q + 1], success)
        found = []
        for t in range(TABLES):
            own, b = home[order[t], t], bucket[table == t]
            lo, hi = np.searchsorted(own, b, "left"), np.searchsorted(own, b, "right")
            found += [order[t][x:y] for x, y in zip(lo, hi, strict=True) if y > x]
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        pairs, distinct, visits = pairs + len(every), distinct + len(np.unique(every)), visits + len(bucket)
        hit += len(np.intersect1d(every, want))
    n = len(truth)
    return Report(made.projections, made.radius, hit / (n * neighbours), pairs / n / len(vectors), distinct / n / len(vectors), visits / n)
