"""Operator 1, language identification: segmentation-marginalised unigrams.

Words (runs of letters, lower-cased, after a word mark) are segmented into pieces of a fixed public vocabulary. A
language is a probability for each piece; a word's probability is the sum over all its segmentations of the products of their pieces'
probabilities, by a forward algorithm. Expectation-maximisation (forward-backward over all segmentations) fits the pieces' probabilities
to word counts of a bounded sample: about PER_LANGUAGE documents of each language, chosen by hash of doc_id.

The forward algorithm runs over many different words at once: positions outside, words inside. All pieces of the vocabulary take part, and
words of any length are scored whole: where probabilities get small, the last positions are scaled up and the scale is kept aside. Only the
fit takes words of over SPAN letters (from the bounded sample) in spans of that many.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every text with letters is ``und``
too; ties go to the language that sorts first; repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, map_text, share_below, stream64, texts

PER_LANGUAGE = 1_500
FOLDS, HELD_OUT = 3, 1
ROUNDS = 3
#: Letters of a word that the fit takes at once.
SPAN = 40
#: Characters of words, padding included, that are scored at once.
CELLS = 400_000
MARK = "▁"
#: Different words of a worker whose scores are kept; the store is emptied when it is full.
KEPT = 600_000
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lattice(NamedTuple):
    """For words in columns: the vocabulary index of the piece that ends at a position and has a length, -1 if none."""

    piece: np.ndarray  # [length - 1, position, word]
    length: np.ndarray  # characters of each word, mark included


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted hashes of the vocabulary's lower-cased letter pieces, their indexes, how many, and the longest's characters; one more index stands for any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i).lower()).strip(MARK).isalpha()}
    names = sorted(kept | {MARK})
    chars, length = padded(names)
    hashes = prefix_hashes(chars)[length, np.arange(len(names))]
    order = np.argsort(hashes)
    return hashes[order], order, len(names), max(map(len, names))


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in columns, zeros after the end, and the lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((int(length.max()), len(words)), np.uint32)
    column = np.repeat(np.arange(len(words)), length)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length), column] = flat
    return out, length


_SALT = stream64(1 << 12, 7)


def prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes of each word's beginnings, the empty one first."""
    code = _SALT[chars & 0xFFF] + (chars >> 12).astype(np.uint64) * _STEP
    out = np.zeros((chars.shape[0] + 1, chars.shape[1]), np.uint64)
    for i in range(chars.shape[0]):
        out[i + 1] = out[i] * _STEP + code[i]
    return out


def lattice(words: list[str], path: str) -> Lattice:
    hashes, order, n, longest = pieces(path)
    chars, length = padded(words)
    prefix = prefix_hashes(chars)
    top = chars.shape[0]
    out = np.full((min(longest, top), top, len(words)), -1, np.int32)
    power = np.ones(1, np.uint64)
    for k in range(1, min(longest, top) + 1):
        power = power * _STEP
        h = prefix[k:] - prefix[:-k] * power
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        hit &= np.arange(k, top + 1)[:, None] <= length
        out[k - 1, k - 1 :][hit] = order[at[hit]]
    # a character that is no piece by itself is "any other", so every word has a segmentation
    alone = out[0]
    alone[(alone < 0) & (np.arange(1, top + 1)[:, None] <= length)] = n
    return Lattice(out, length)


_TINY, _LIFT = 1e-100, 1e100


def forward(lat: Lattice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[position, word, language]: the summed probability of all segmentations of each beginning; and the logarithms of the whole words'.

    Positions are scaled in batches with words of over SPAN letters only, so what the fit reads of them is not.
    """
    k_max, top, words = lat.piece.shape
    padded_p = np.vstack([p, np.zeros((1, p.shape[1]))])  # index -1: no piece
    a = np.zeros((top + 1, words, p.shape[1]))
    a[0] = 1
    scale, whole = np.zeros(a.shape[1:]), np.zeros(a.shape[1:])
    for j in range(1, top + 1):
        for k in range(1, min(k_max, j) + 1):
            own = lat.piece[k - 1, j - 1]
            if (some := np.flatnonzero(own >= 0)).size:
                a[j, some] += a[j - k, some] * padded_p[own[some]]
        if (done := np.flatnonzero(lat.length == j)).size:
            whole[done] = np.log(np.maximum(a[j, done], 1e-300)) + scale[done]
        if j % 8 == 0 and SPAN + 1 < top:
            last = a[max(0, j - k_max + 1) : j + 1]
            low = (a[j] < _TINY) & (a[j] > 0)
            if low.any():
                last[:, low] *= _LIFT
                scale[low] -= np.log(_LIFT)
    return a, whole


def batches(words: list[str]) -> list[list[int]]:
    """Numbers of the words, shortest first, in batches of about CELLS characters with padding."""
    out: list[list[int]] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if not out or len(out[-1]) >= 20_000 or (len(out[-1]) + 1) * (len(words[i]) + 1) > CELLS:
            out.append([])
        out[-1].append(i)
    return out


def log_scores(words: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """[word, language] log-probabilities."""
    out = np.zeros((len(words), p.shape[1]))
    for some in batches(words):
        out[some] = forward(lattice([MARK + words[i] for i in some], path), p)[1]
    return out


def expected_counts(words: list[str], count: np.ndarray, p: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, so often as they occur; p is of one language."""
    total = np.zeros(len(p))
    spans = [(i, w[a : a + SPAN]) for i, w in enumerate(words) for a in range(0, len(w), SPAN)]
    spans.sort(key=lambda x: len(x[1]))
    for s in range(0, len(spans), 20_000):
        part = [i for i, _ in spans[s : s + 20_000]]
        lat = lattice([MARK + w for _, w in spans[s : s + 20_000]], path)
        a = forward(lat, p[:, None])[0][:, :, 0]
        k_max, top, n = lat.piece.shape
        b = np.zeros((top + 1, n))
        b[lat.length, np.arange(n)] = 1
        full = np.maximum(a[lat.length, np.arange(n)], 1e-300)
        weight = count[part] / full
        for j in range(top, 0, -1):
            for k in range(1, min(k_max, j) + 1):
                own = lat.piece[k - 1, j - 1]
                some = np.flatnonzero(own >= 0)
                if some.size:
                    use = p[own[some]] * b[j, some]
                    np.add.at(total, own[some], a[j - k, some] * use * weight[some])
                    b[j - k, some] += use
    return total


class Model(NamedTuple):
    languages: list[str]
    pieces: np.ndarray  # [piece, language]
    prior: np.ndarray
    path: str


def fit_pieces(counts: dict[str, dict[str, int]], path: str, documents: dict[str, int], rounds: int = ROUNDS, smooth: float = 0.1) -> Model:
    """Probabilities from word counts by language."""
    n = pieces(path)[2] + 1
    languages = sorted(counts)
    columns = []
    for lang in languages:
        words = list(counts[lang])
        count = np.array([counts[lang][w] for w in words], float)
        p = np.full(n, 1 / n)
        for _ in range(rounds):
            uses = expected_counts(words, count, p, path) + smooth
            p = uses / uses.sum()
        columns.append(p)
    prior = np.array([documents.get(x, 0) + 1 for x in languages], float)
    return Model(languages, np.stack(columns, axis=1) if columns else np.zeros((n, 0)), np.log(prior / prior.sum()) if languages else prior, path)


def fit(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", held_out: int | None = HELD_OUT, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from labelled rows outside the held-out fold. The sample is bounded by ``per_language`` expected documents a language."""
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and lang is not null")
    if held_out is not None:
        known = known.where(bucket("id", FOLDS) != held_out)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    wanted = F.lit(False)
    for name, n in sizes.items():
        wanted = wanted | ((F.col("lang") == name) & share_below(F.col("id"), min(1.0, per_language / n)))

    def work(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for t, own in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
            seen.update((own, w) for w in LETTERS.findall(t.lower()))
        return {"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}

    words = map_text(known.where(wanted).select("text", "lang"), work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "word"])
    counts: dict[str, dict[str, int]] = {}
    for own, rows in words.groupby("lang"):
        counts[own] = dict(zip(rows["word"], rows["n"], strict=True))
    return fit_pieces(counts, path, sizes)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float64)
        self.letter = np.zeros(0, bool)

    def __call__(self, batch: list[str]) -> tuple[list[str], list[float]]:
        if len(self.index) > KEPT:
            self.__init__(self.model)
        found = [LETTERS.findall(t.lower()) for t in batch]
        known = self.index
        if new := list({w for own in found for w in own if w not in known}):
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, log_scores(new, self.model.pieces, self.model.path)])
            self.letter = np.concatenate([self.letter, np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))])
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64)
        ends = np.cumsum([0, *map(len, found)])
        words = np.concatenate(([0], np.cumsum(self.letter[code])))
        some = words[ends[1:]] > words[ends[:-1]]
        lang, score = [UNDETERMINED] * len(batch), [0.0] * len(batch)
        if not self.model.languages or not some.any():
            return lang, score
        rows = np.flatnonzero(some)
        total = np.add.reduceat(self.scores[code], ends[rows]) + self.model.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(rows.tolist(), best.tolist(), share.tolist(), strict=True):
            lang[i], score[i] = self.model.languages[b], s
        return lang, score


#: A worker's scorer, kept between its tasks.
_KEPT: list[Scorer] = []


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the data

    def work(batch: pa.RecordBatch) -> dict:
        if not _KEPT or _KEPT[0].model is not shared.value:
            _KEPT[:] = [Scorer(shared.value)]
        lang, score = _KEPT[0](texts(batch))
        return {"k": batch.column(0), "lang_pred": lang, "score": score}

    kind = docs.schema[key].dataType.simpleString()
    made = map_text(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, lang_pred string, score double")
    return made.select(F.col("k").alias(key), (bucket("k", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
