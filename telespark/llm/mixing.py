"""Operator 2, mixing sources to target weights: soft-membership mixing.

A classifier trained on the labelled table predicts each document's posterior p over domains (a domain is one combination of label
values). With a document's n tokens spread over the domains by its posterior, projected least squares fits one nonnegative rate r per
document so that the expected token totals, the sum of r n p, meet the targets: a target share times all tokens of the domains that have a
target. Rates start at 1 and are moved as little as that takes, every token counting alike: r = max(0, 1 + p . v) with one vector v for all
documents, so documents of one domain are treated alike, however long. v is found by Newton's method on the totals: a step is
(G + CHANGE * G0)+ e, where e is what the totals still lack, G the sum of n p p' over the documents whose rate is not at 0 and G0 that of all.
A step that makes things worse is halved. The fit ends when the optimality condition holds to CLOSE, and says so in the log if it does not
after ROUNDS passes. The driver holds only G, e and v, a few numbers per domain; every executor works out its documents' rates from v.

A document is then taken rate times: the whole part, and once more with the fractional part as its chance, by a hash of its id.

The training sample is bounded by LABELLED rows. Tokens here are white-space separated words.

Defined cases: a null or empty text has no tokens, keeps rate 1 and is taken once; repeated rows each get the rate of their text; several
labels of one doc_id: the greatest; rows with null labels teach nothing; without labelled documents, or targets for their domains, all rates
are 1; domains without a target pull no rate; where posteriors of two domains tie, the first by name is the likeliest; if no rates meet the
targets, the squared lack (in units of G0) plus CHANGE times the squared change of the rates is least, and the log tells the lack; whole texts
are read, however long; an empty table gives an empty table; other columns are kept by the stage.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, give_back, least_ids, map_text, materialise, share_below, steps, tidy, utf8
from .words import NOT_LETTERS, Words, hashed_words

LABELLED = 6_000
BITS = 16
#: Passes over the rows at most; about ten are needed.
ROUNDS = 100
#: Distance from optimality, as a share of all tokens, at which the fit ends.
CLOSE = 1e-6
#: What a squared change of the rates weighs beside a squared lack.
CHANGE = 1e-6
#: Target shares of tokens by domain (quality, toxic) in the query and the pipeline.
TARGETS = {"q1t0": 0.9, "q0t0": 0.1}


class Classifier(NamedTuple):
    domains: list[str]
    dense: np.ndarray  # [feature, domain]
    words: np.ndarray  # [bucket, domain]
    mean: np.ndarray
    scale: np.ndarray


class Features(NamedTuple):
    tokens: np.ndarray
    dense: np.ndarray
    index: np.ndarray
    bounds: np.ndarray


def features(column: pa.Array) -> Features:
    """Numbers of words, byte shares and shape of each text, and its distinct hashed letter words."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    share = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    tokens = np.diff(hashed_words(data, offsets).bounds)
    words: Words = hashed_words(data, offsets, NOT_LETTERS)
    key = np.unique((np.repeat(np.arange(n, dtype=np.int64), np.diff(words.bounds)) << BITS) | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64))
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << BITS)
    shape = np.stack([np.log1p(tokens), np.diff(bounds) / np.maximum(np.diff(words.bounds), 1), size / np.maximum(tokens, 1)], axis=1)
    return Features(tokens, np.concatenate([share, shape], axis=1), key & ((1 << BITS) - 1), bounds)


def sums(weights: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's sum of its words' weights, one domain at a time: what is in memory at once doesn't grow with the domains."""
    out = np.empty((len(bounds) - 1, weights.shape[1]))
    total = np.zeros(len(index) + 1)
    for j in range(weights.shape[1]):
        np.cumsum(np.ascontiguousarray(weights[:, j])[index], out=total[1:])
        out[:, j] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def posteriors(c: Classifier, f: Features) -> np.ndarray:
    z = ((f.dense - c.mean) / c.scale) @ c.dense[:-1] + c.dense[-1] + sums(c.words, f.index, f.bounds)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(f: Features, label: np.ndarray, domains: list[str], rounds: int = 150, rate: float = 0.02, decay: float = 1e-3, least: int = 10) -> Classifier:
    """Softmax regression by Adam."""
    n, k = len(label), len(domains)
    mean, scale = f.dense.mean(axis=0), f.dense.std(axis=0) + 1e-6
    x = np.concatenate([(f.dense - mean) / scale, np.ones((n, 1))], axis=1)
    known = np.flatnonzero(np.bincount(f.index, minlength=1 << BITS) >= least)
    to = np.full(1 << BITS, -1, np.int32)
    to[known] = np.arange(len(known))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(f.bounds))
    keep = to[f.index] >= 0
    row, column = row[keep], to[f.index][keep]
    ends = np.searchsorted(row, np.arange(n + 1))
    one = np.eye(k)[label]
    params = [np.zeros((x.shape[1], k)), np.zeros((len(known), k))]
    params[0][-1] = np.log((one.sum(axis=0) + 1) / (n + k))
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        z = x @ params[0] + sums(params[1], column, ends)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - one) / n
        by_word = np.stack([np.bincount(column, weights=g[row, j], minlength=len(known)) for j in range(k)], axis=1)
        for i, grad in enumerate((x.T @ g + decay * params[0], by_word + decay * params[1])):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)
    words = np.zeros((1 << BITS, k))
    words[known] = params[1]
    return Classifier(domains, params[0], words, mean, scale)


def fit_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Classifier | None:
    """Learn the domains from at most LABELLED labelled documents of docs, least hash of the id first. None without any."""
    named = labels.where(f"{key} is not null and quality is not null and toxic is not null").select(F.col(key).alias("id"), F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain"))
    of = docs.select(F.col(key).alias("id"))
    at = lambda share: named.where(share_below(F.col("id"), share)).join(of.where(share_below(F.col("id"), share)), "id", "left_semi")
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in least_ids(labels.count(), LABELLED, at)], "id long")
    sample = named.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.max("domain").alias("domain")).toPandas()
    if sample.empty:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(i), d) for i, d in sample.itertuples(index=False)], "id long, domain string"))

    def work(batch: pa.RecordBatch) -> dict:
        f = features(batch.column("text"))
        return {"id": batch.column(0), "domain": batch.column(2), "tokens": f.tokens, "dense": list(f.dense), "index": pa.ListArray.from_arrays(pa.array(f.bounds.astype(np.int32)), pa.array(f.index.astype(np.int32)))}

    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id").select("id", "text", "domain")
    rows = map_text(found, work, "id long, domain string, tokens long, dense array<double>, index array<int>").toArrow().sort_by("id").combine_chunks()
    if not rows.num_rows:
        return None
    label = np.array(rows.column("domain").to_pylist())
    domains = sorted(set(label.tolist()))
    index = rows.column("index").combine_chunks()
    dense = rows.column("dense").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    f = Features(rows.column("tokens").to_numpy(), dense, index.flatten().to_numpy(), np.concatenate(([0], np.cumsum(index.value_lengths().to_numpy()))).astype(np.int64))
    made = train(f, np.searchsorted(domains, label), domains)
    del rows, index, dense, f
    give_back()
    return made


def expected_tokens(docs: DataFrame, classifier: Classifier, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and posterior (array by domain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # buckets x domains, whatever the data

    def work(batch: pa.RecordBatch) -> dict:
        f = features(batch.column("text"))
        return {"k": batch.column(0), "n_tokens": f.tokens, "posterior": list(posteriors(shared.value, f))}

    kind = docs.schema[key].dataType.simpleString()
    made = map_text(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, n_tokens long, posterior array<double>")
    return made.withColumnRenamed("k", key)


def rate_of(v: np.ndarray) -> Column:
    """The rate that v gives a row of (n_tokens, posterior)."""
    pull = sum((F.col("posterior")[d] * float(x) for d, x in enumerate(v) if x), F.lit(0.0))
    return F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), F.lit(1.0) + pull)).otherwise(1.0)


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], rounds: int = ROUNDS) -> np.ndarray:
    """The optimal v over a written table of (n_tokens, posterior); 0 for domains without a target."""
    named = [d for d, name in enumerate(domains) if name in targets]
    k = len(named)
    v = np.zeros(len(domains))
    all_tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not all_tokens or not k:
        return v
    n = F.col("n_tokens") / F.lit(float(all_tokens))
    p = [F.col("posterior")[d] for d in named]

    def at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, the Gram matrix of the rows whose rate is not at 0, and half the sum of squared rates, as shares of all tokens."""
        table = rows.where("n_tokens > 0").select(rate_of(v).alias("rate"), n.alias("n"), *(x.alias(f"p{i}") for i, x in enumerate(p)))
        free = F.when(F.col("rate") > 0, F.col("n")).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        sums = table.agg(*(F.sum(F.col("rate") * F.col("n") * F.col(f"p{i}")) for i in range(k)), *(F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs), F.sum(F.col("n") * F.col("rate") * F.col("rate"))).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums[k:-1], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(sums[:k], float), gram, sums[-1] / 2

    now, free_gram, half = at(v)
    share = np.array([max(0.0, targets[domains[d]]) for d in named])
    goal = share / (share.sum() or 1) * now.sum()
    gram, value = free_gram, half
    for _ in range(rounds):
        slope = now - goal + CHANGE * gram @ v[named]
        if np.abs(slope).max() <= CLOSE:
            break
        step = -np.linalg.pinv(free_gram + CHANGE * gram, rcond=1e-13, hermitian=True) @ slope
        part = 1.0
        while True:  # the whole step as a rule; bounds that it meets may call for less
            near = v.copy()
            near[named] += part * step
            found = at(near)
            new = found[2] - goal @ near[named] + CHANGE / 2 * near[named] @ gram @ near[named]
            better = new <= value + 1e-4 * part * (slope @ step) + 1e-12
            if better or part < 1e-6:
                break
            part /= 2
        if not better:
            break
        v, value, (now, free_gram, half) = near, new, found
    off = np.abs(now - goal + CHANGE * gram @ v[named]).max()
    if off > CLOSE:
        logging.getLogger(__name__).warning("the rates are not optimal: %s of all tokens off", off)
    lack = dict(zip((domains[d] for d in named), (goal - now).round(6).tolist(), strict=True))
    if max(map(abs, lack.values())) > 1e-4:
        logging.getLogger(__name__).warning("no rates meet the targets; shares of all tokens that are lacking: %s", lack)
    return v


def copies_of(rate: Column, key: str) -> Column:
    """How often a document is taken: its rate, rounded up with the fractional part as chance by a hash of the key."""
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + F.coalesce(chance, F.lit(0.0))).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, domain (the likeliest), posterior, rate and copies of every row."""
    classifier = fit_classifier(docs, labels, text, key)
    if classifier is None:
        classifier = Classifier([""], np.zeros((260, 1)), np.zeros((1 << BITS, 1)), np.zeros(259), np.ones(259))
        targets = {}
    rows = materialise(expected_tokens(docs, classifier, text, key))
    rate = rate_of(fit_rates(rows, classifier.domains, targets))
    names = F.array(*map(F.lit, classifier.domains))
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return rows.select(key, "n_tokens", F.element_at(names, likeliest).alias("domain"), "posterior", rate.alias("rate"), copies_of(rate, key).alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of docs as often as its rate says, with all its columns. Texts are never shuffled: a second pass works out the rates again."""
    classifier = fit_classifier(docs, labels, text, key)
    if classifier is None:
        return docs
    rows = materialise(expected_tokens(docs, classifier, text, key).select("n_tokens", "posterior"))
    v = fit_rates(rows, classifier.domains, targets)
    discard(rows)
    shared = docs.sparkSession.sparkContext.broadcast((classifier, v))
    chance = fresh("_chance", docs)
    dealt = docs.withColumn(chance, F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30))

    def run(batches):
        model, pull = shared.value
        for part in steps(batches, text):
            f = features(part.column(text))
            rate = np.where(f.tokens > 0, np.maximum(0.0, 1.0 + posteriors(model, f) @ pull), 1.0)
            n = np.floor(rate + pc.fill_null(part.column(chance), 0.0).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield part.take(pa.array(np.repeat(np.arange(part.num_rows), n))).drop_columns([chance])

    return dealt.mapInArrow(tidy(run), docs.schema)
