"""Operator 5, token counts: byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie in one flat array of symbols with segment bounds. Every round finds
each sequence's lowest-ranked adjacent pair, merges all its occurrences in all sequences at once, and
drops sequences without a mergeable pair. A pair that a merge makes always ranks after it, so doing all
occurrences at once gives what the library's queue gives. What is left are the tokens.

Defined cases: a null text is empty and has 0 tokens; repeated rows give repeated results; other
columns are ignored, whatever their names; an empty table gives an empty table; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, texts

#: The published pre-token pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone split alike in every regular-expression library; others go to the tokenizer's own splitter.
PLAIN = re.compile("[^\t-\r -~ -ɏ]")
#: Pre-tokens of a worker whose counts are kept; the store is emptied when it is full.
KEPT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ArrayMerger:
    """Counts what byte sequences become under a list of ranked merges."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.special = [t["content"] for t in model["added_tokens"]]
        symbols = byte_symbols()
        self.bytes = np.array([vocab[c] for c in symbols], np.int64)
        self.of = {c: b for b, c in enumerate(symbols)}
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def pair_ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of each symbol with its right neighbour; the number of merges where they don't merge."""
        none = len(self.made)
        rank = np.full(len(symbols), none, np.int64)
        if len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & ~last[:-1]
            rank[:-1][hit] = self.ranks[at[hit]]
        return rank

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        ids = np.flatnonzero(length)
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        length = length[ids]
        while len(ids):
            start = np.concatenate(([0], np.cumsum(length)[:-1]))
            last = np.zeros(len(symbols), bool)
            last[start + length - 1] = True
            rank = self.pair_ranks(symbols, last)
            best = np.minimum.reduceat(rank, start)
            done = best == len(self.made)
            if done.any():
                out[ids[done]] = length[done]
                keep = np.repeat(~done, length)
                symbols, rank, last = symbols[keep], rank[keep], last[keep]
                ids, length, best = ids[~done], length[~done], best[~done]
                if not len(ids):
                    break
            own = np.repeat(best, length)
            hit = rank == own
            # of adjacent occurrences (a run such as "aaaa"), every second one merges, from the left
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[own[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            which = np.repeat(np.arange(len(ids)), length)
            length = length - np.bincount(which[gone], minlength=len(ids))
            symbols = symbols[~gone]
        return out


class Counter:
    """Counts the tokens of whole texts as the tokenizer file's library does by default."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.merger = ArrayMerger(path)
        self.find = regex.compile(PATTERN).findall
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(map(re.escape, self.merger.special)) or "(?!)")
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if PLAIN.search(text) is None:
            return self.find(text)
        of = self.merger.of
        return [bytes(of[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in self.split(text)]

    def __call__(self, batch: list[str]) -> np.ndarray:
        """Tokens of each text. Pre-tokens not met before are merged together, in one ragged array."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        split: list[list[list[str]]] = []
        extra = np.zeros(len(batch), np.int64)
        for i, text in enumerate(batch):
            if "<|" in text:
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                split.append([self.pieces(p) for p in parts if p])
            else:
                split.append([self.pieces(text)] if text else [])
        new = list({p for parts in split for own in parts for p in own if p not in known})
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            known.update(zip(some, self.merger.counts([p.encode("utf-8", "surrogateescape") for p in some]).tolist(), strict=True))
        get = known.__getitem__
        return extra + np.fromiter((sum(sum(map(get, own)) for own in parts) for parts in split), np.int64, len(batch))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; the tokenizer file at ``path`` is read on each executor."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = texts(batch)
        n = counter(path)(rows)
        return {"k": batch.column(0), "n_bytes": [len(x.encode()) for x in rows], "n_tokens": n, "over_limit": n > limit}

    kind = df.schema[key].dataType.simpleString()
    made = map_text(df.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return made.withColumnRenamed("k", key)
