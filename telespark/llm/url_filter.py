"""Operator 7, URL filters: a sorted digest array.

The keys (host and path beginnings, or whole URLs) of a list are stored in one file: 64-bit xxhash digests in ascending
order, where each key's bytes lie, and the bytes. The file lies in the shared folder; Spark copies it to every executor, which maps it into memory, probes
it for a batch of URLs with one vectorised binary search, and compares the stored string of every hit, so digests that collide decide nothing.

A rule (host, path) fits the host, all its subdomains, and paths that begin with its path. For each URL the probes are its host's
suffixes joined with as many first characters of its path as any rule has; the longest confirmed key wins (then the
longer host). URLs without a rule are blocked if the list of blocked URLs holds them whole, and else allowed.

Defined cases: equal rules count once, and two verdicts for one rule are an error; a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; an empty
table gives an empty table; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, write_shared

MAGIC = b"DIGARR2\0"
#: Verdicts by the byte that the file has for a rule.
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def pack(keys: Iterable[str] | dict[str, int]) -> bytes:
    """The file's bytes: magic, number of keys, digests in order, offsets, a byte for each key (0 if none is given), strings in the digests' order."""
    values = keys if isinstance(keys, dict) else dict.fromkeys(keys, 0)
    raw = sorted((k.encode(), v) for k, v in values.items())
    d = digests([k for k, _ in raw])
    order = np.lexsort((np.arange(len(raw)), d))
    raw = [raw[i] for i in order]
    offsets = np.cumsum([0, *(len(k) for k, _ in raw)]).astype("<u8")
    return MAGIC + struct.pack("<Q", len(raw)) + d[order].astype("<u8").tobytes() + offsets.tobytes() + bytes(v for _, v in raw) + b"".join(k for k, _ in raw)


class DigestArray:
    """A packed file, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is not a digest array")
        n = int(data[8:16].view("<u8")[0])
        self.digests = data[16 : 16 + 8 * n].view("<u8")
        self.offsets = data[16 + 8 * n : 24 + 16 * n].view("<u8")
        self.values = data[24 + 16 * n : 24 + 17 * n]
        self.blob = data[24 + 17 * n :]

    def find(self, keys: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
        """For each key its place in the list, or -1. ``own`` are its digests, where a test wants collisions."""
        n = len(self.digests)
        out = np.full(len(keys), -1, np.int64)
        if not n or not keys:
            return out
        d = digests(keys) if own is None else own
        at = np.searchsorted(self.digests, d)
        for i in np.flatnonzero((at < n) & (self.digests[np.minimum(at, n - 1)] == d)).tolist():
            k = int(at[i])
            while k < n and self.digests[k] == d[i]:
                if self.blob[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes() == keys[i]:
                    out[i] = k
                    break
                k += 1
        return out


def publish(spark: SparkSession, keys: Iterable[str] | dict[str, int]) -> str:
    """Hand the list to all executors; the name to open there. Equal lists are handed out once."""
    data = pack(keys)
    name = f"digests-{xxhash.xxh3_128_hexdigest(data)}.bin"
    handed = spark.sparkContext.__dict__.setdefault("_telespark_files", set())
    if name not in handed:
        spark.sparkContext.addFile(write_shared(spark, name, data))
        handed.add(name)
    return name


@lru_cache(maxsize=8)
def opened(path: str) -> DigestArray:
    return DigestArray(path)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path, by column functions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns({"host": F.translate(host, UPPER, LOWER), "path": path}).drop("_rest")


def suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def judge(df: DataFrame, rules: list[Rule], blocked_urls: Iterable[str] = (), url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of every row."""
    spark = df.sparkSession
    # a key says where its host ends; its verdict is in the file too, so tasks carry nothing that grows with the list
    verdicts: dict[str, int] = {}
    for r in rules:
        if verdicts.setdefault(f"{r.host}\0{r.path}", VERDICTS.index(r.verdict)) != VERDICTS.index(r.verdict):
            raise ValueError(f"two verdicts for {r.host}{r.path}")
    blocked = list(blocked_urls)
    rule_file = publish(spark, verdicts)
    list_file = publish(spark, blocked) if blocked else None
    widths = sorted({len(r.path) for r in rules})
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        array = opened(SparkFiles.get(rule_file))
        urls, hosts, paths = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
        probes, owner = [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            if not h:
                continue
            for s in suffixes(h):
                for w in widths:
                    if w <= len(p):
                        probes.append((s, p[:w]))
                        owner.append(i)
        best: dict[int, tuple[int, int, str, int]] = {}
        found = array.find([f"{s}\0{p}".encode() for s, p in probes])
        for j in np.flatnonzero(found >= 0).tolist():
            s, p = probes[j]
            best[owner[j]] = max(best.get(owner[j], (0, 0, "", 0)), (len(s) + len(p), len(s), s + p, int(array.values[found[j]])))
        listed = np.full(len(urls), -1)
        if list_file:
            listed = opened(SparkFiles.get(list_file)).find([(u or "").encode() for u in urls])
        rule = [best[i][2] if i in best else None for i in range(len(urls))]
        verdict = [VERDICTS[best[i][3]] if i in best else "block" if hit >= 0 else "allow" for i, hit in enumerate(listed)]
        return {"k": batch.column(0), "host": batch.column(2), "path": batch.column(3), "rule": rule, "verdict": verdict}

    ready = split_url(df.select(F.col(key).alias("k"), F.col(url).alias("url"))).select("k", "url", "host", "path")
    return map_text(ready, work, f"k {kind}, host string, path string, rule string, verdict string", "url").withColumnRenamed("k", key)
