"""Operator 9, toxicity: non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings (letters only, A-Z lower-cased, presence per document) is trained in numpy from confirmed
toxic documents and unlabelled ones. With prior p, positive risks R+(+1), R+(-1) and unlabelled risk Ru(-1), it minimises
p R+(+1) + max(0, Ru(-1) - p R+(-1)): the share of the unlabelled risk that toxic documents among them cause is taken off, and what is
left, the risk on clean documents, is not let below zero; where it would be, the step goes the other way, as published.

The training sample is bounded: at most POSITIVES toxic and UNLABELLED unlabelled documents of the training folds, least
hash of doc_id first. A word that no unlabelled one of them has keeps its weight, which decay bounds: it may be used in toxic documents only. The prior is the toxic share of the labelled rows of the training folds. Everything else covers all documents.

Defined cases: a null or empty text gets the score of no words; a score of exactly 0.5 is toxic; repeated rows give repeated results; several labels of one doc_id
count as toxic if one is; null labels are no labels; without any toxic or unlabelled training document every score is the prior
(0 without labels); an empty table gives an empty table; other columns are ignored; whole texts are scored, however long.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, give_back, least_ids, map_text, mix64, share_below, steps, stream64, tidy, utf8
from .words import NOT_LETTERS, hashed_words, shingle_sets

BITS = 18
#: Beside whole words, their first so many bytes are features: inflected words share them.
BEGINNINGS = (4, 5)
POSITIVES, UNLABELLED = 3_000, 9_000
FOLDS = 5
#: Features that fewer confirmed documents have carry no weight.
LEAST_DOCS, LEAST_SHARE = 3, 0.01
#: Features whose share among confirmed documents differs from that among the others by fewer deviations carry no weight.
SURPRISE = 2.0
#: How far, in log-odds, the threshold may move to meet the prior.
SHIFT = 0.5
#: Least shingle hashes by which near copies in the sample are told.
MARKS = 3
_SALT = stream64(MARKS, 9)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def word_buckets(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashed words in a row, and their bounds."""
    words = hashed_words(*utf8(column), NOT_LETTERS, BEGINNINGS)
    texts = len(words.bounds) - 1
    owner = np.repeat(np.arange(texts, dtype=np.int64), np.diff(words.bounds))
    key = np.unique((owner << bits) | (words.hashes >> np.uint64(64 - bits)).astype(np.int64))
    return key & ((1 << bits) - 1), np.searchsorted(key, np.arange(texts + 1, dtype=np.int64) << bits)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk of scores f with the logistic loss, the risk on clean documents that it holds, and the step's gradient by f.

    Where the clean risk is below zero, the gradient is that of its negative, which leads it back up.
    """
    n_pos, n_un = int(positive.sum()), int((~positive).sum())
    s, as_clean = sigmoid(f), np.logaddexp(0, f)
    clean_risk = float(as_clean[~positive].mean() - prior * as_clean[positive].mean())
    value = prior * float(np.logaddexp(0, -f[positive]).mean()) + max(0.0, clean_risk)
    clean = np.where(positive, -prior * s / n_pos, s / n_un)
    return value, clean_risk, clean + np.where(positive, -prior * (1 - s) / n_pos, 0) if clean_risk >= 0 else -clean


def train(index: np.ndarray, bounds: np.ndarray, positive: np.ndarray, prior: float, bits: int = BITS, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam on the non-negative risk with the logistic loss, over rows of distinct buckets; the mean of the later half's iterates."""
    seen = np.bincount(index, minlength=1 << bits)
    row = np.repeat(np.arange(len(positive), dtype=np.int32), np.diff(bounds))
    confirmed = np.bincount(index[positive[row]], minlength=1 << bits)
    n_pos, n_un = int(positive.sum()), int((~positive).sum())
    expected = (seen - confirmed) * (n_pos / n_un)
    surprise = (confirmed - expected) / np.sqrt(expected + 1)
    known = np.flatnonzero((confirmed >= max(LEAST_DOCS, LEAST_SHARE * n_pos)) & (np.abs(surprise) >= SURPRISE))
    to = np.full(1 << bits, -1, np.int32)
    to[known] = np.arange(len(known))
    keep = to[index] >= 0
    row, column = row[keep], to[index][keep]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(positive)))))
    w, b = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    w_mean, b_mean = np.zeros(len(known)), 0.0
    m1, m2, v1, v2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        f = sums(w[column], ends) + b
        g = risk(f, positive, prior)[2]
        gw = np.bincount(column, weights=g[row], minlength=len(w)) + decay * w
        gb = float(g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        v1, v2 = 0.9 * v1 + 0.1 * gb, 0.999 * v2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        b = b - rate * (v1 / c1) / (np.sqrt(v2 / c2) + 1e-6)
        if 2 * t > rounds:
            w_mean, b_mean = w_mean + w, b_mean + b
    half = rounds - rounds // 2
    w, b = w_mean / half, b_mean / half
    # the share of unlabelled documents at 0.5 or above moves towards the prior, as far as SHIFT lets it: labels may not be a fair sample
    f = np.sort(sums(w[column], ends)[~positive])
    b = float(np.clip(-f[min(n_un - 1, int(n_un * (1 - prior)))], b - SHIFT, b + SHIFT))
    full = np.zeros(1 << bits)
    full[known] = w
    return Model(full, b)


def distinct_rows(positive: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Rows that share no mark (least shingle hash) with an earlier row of their class: near copies teach nothing new."""
    seen: list[set[tuple[bool, int]]] = [set() for _ in range(marks.shape[1])]
    kept = []
    for i, (p, own) in enumerate(zip(positive.tolist(), marks.tolist(), strict=True)):
        key = [(p, m) for m in own]
        if not any(k in s for k, s in zip(key, seen, strict=True)):
            kept.append(i)
        for k, s in zip(key, seen, strict=True):
            s.add(k)
    return np.array(kept, np.int64)


def sample_features(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, buckets and near-copy marks of each row."""

    def work(batch: pa.RecordBatch) -> dict:
        column = batch.column("text")
        index, bounds = word_buckets(column)
        elements, ends = shingle_sets(hashed_words(*utf8(column)), 5)
        marks = np.zeros((batch.num_rows, MARKS), np.uint64)
        some = np.flatnonzero(np.diff(ends))
        for m in range(MARKS if len(some) else 0):
            marks[some, m] = np.minimum.reduceat(mix64(elements ^ _SALT[m]), ends[some])
        return {"id": batch.column(0), "buckets": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(index.astype(np.int32))), "marks": list(marks.view(np.int64))}

    return map_text(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), work, "id long, buckets array<int>, marks array<long>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", held_out: int | None = 0) -> Model:
    """Train on the folds other than ``held_out`` (None: all). What reaches the driver is bounded by POSITIVES and UNLABELLED."""
    usable = lambda df: df.where(F.col(key).isNotNull() if held_out is None else F.col(key).isNotNull() & (bucket(key, FOLDS) != held_out))
    marked = usable(labels).where("toxic is not null")
    n, toxic = marked.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    prior = toxic / n if n else 0.0
    of = lambda df, share: df.select(F.col(key).alias("id")).where(share_below(F.col("id"), share))
    positive = least_ids(toxic, POSITIVES, lambda share: of(marked.where("toxic > 0"), share).join(of(docs, share), "id", "left_semi")) if toxic else []
    other = least_ids(docs.count(), UNLABELLED, lambda share: of(usable(docs), share))
    if not positive or not other or prior >= 1:
        return Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 40.0 if prior else -40.0)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in {*positive, *other}], f"{key} long"))
    rows = sample_features(docs.join(wanted, key, "left_semi"), text, key).toArrow().sort_by("id").combine_chunks()
    ids = rows.column("id").to_numpy()
    first_row = np.unique(ids, return_index=True)[1]  # repeated rows of one id: one
    of = dict(zip(ids[first_row].tolist(), first_row.tolist(), strict=True))
    found = [(of[i], p) for own, p in ((positive, True), (other, False)) for i in own if i in of]
    if not found:
        return Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    at, is_positive = np.array([k for k, _ in found]), np.array([p for _, p in found])
    marks = rows.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, MARKS)
    keep = distinct_rows(is_positive, marks[at])
    at, is_positive = at[keep], is_positive[keep]
    if not is_positive.any() or is_positive.all():
        return Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    taken = rows.column("buckets").combine_chunks().take(pa.array(at))
    index, bounds = taken.flatten().to_numpy(), np.concatenate(([0], np.cumsum(taken.value_lengths().to_numpy()))).astype(np.int64)
    del rows, taken
    model = train(index, bounds, is_positive, prior)
    del index, bounds
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 1 MB, whatever the data

    def work(batch: pa.RecordBatch) -> dict:
        weights, bias = shared.value
        index, bounds = word_buckets(batch.column("text"))
        return {"k": batch.column(0), "score": sigmoid(sums(weights[index].astype(np.float64), bounds) + bias)}

    kind = docs.schema[key].dataType.simpleString()
    made = map_text(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, score double")
    return made.select(F.col("k").alias(key), (bucket("k", FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; null texts stay."""
    model = fit(docs, labels, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches):
        for part in steps(batches, text):
            weights, bias = shared.value
            index, bounds = word_buckets(part.column(text))
            keep = sigmoid(sums(weights[index].astype(np.float64), bounds) + bias) < 0.5
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
