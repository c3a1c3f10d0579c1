"""Operator 8, secret scans: multipart credential linking.

Base findings are assignments, access identifiers and hexadecimal runs. Besides, weak parts are gathered: secret-like
words (long, of mixed character classes, however long), endpoints (addresses, host and region assignments) and account names. A weak part alone says
nothing, so none is reported for itself. The parts of a document are interval-joined: two parts are in one scope if they lie in the
same paragraph (no blank line between them) at most REACH code points apart. Weak parts are reported as spans
only where complementary ones co-occur in a scope:

* an access identifier (strong) and a secret: a secret-like word is a ``linked_secret``;
* those two and an endpoint: the endpoint is a ``linked_endpoint``;
* an account name, a secret and an endpoint: ``linked_account``, ``linked_secret``, ``linked_endpoint``.

A secret is a secret-like word, or an assignment or hexadecimal run of the base findings (strong), which is reported already and gets no second span.
A word within a base finding is none of its own; one that only holds a base finding is. What overlaps an access identifier is not that identifier's secret.

Each document is a scope of its own, so the interval join runs on its sorted offsets, where the text is; no row is shuffled.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; an empty table gives an
empty table; columns beside key and text are ignored; whole texts are scanned, however long; of equal spans one is reported.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, texts

#: Code points between two parts of one credential at most.
REACH = 256
#: The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint", "linked_account")

#: The base patterns and least lengths.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: '=' may stand right before a word (KEY=value) or pad its end.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mongodb|amqp|redis|ftp)://[^\s\"'<>]+|(?i:endpoint|hostname|host|region|bucket)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]{3,}", re.ASCII)
ENDPOINT_SIGN = re.compile(r"://|(?i:endpoint|host|region|bucket)", re.ASCII)
ACCOUNT = re.compile(r"(?i:username|user|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}", re.ASCII)
BLANK_LINE = re.compile(r"\n[\t\r ]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those too short are dropped after matching."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # a run is matched whole from its first character on, so asking for its length at once finds the same runs
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def mixed(word: str) -> bool:
    """At least three of: small letters, capitals, digits, signs; this keeps plain words and hexadecimal digests out."""
    return sum(bool(re.search(c, word)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")) >= 3


def near(a: np.ndarray, b: np.ndarray, scope_a: np.ndarray, scope_b: np.ndarray, reach: int) -> np.ndarray:
    """Which intervals of a (rows of start, end) have one of b in their scope, at most ``reach`` away.

    b is sorted by start. Intervals of one kind never overlap, so b's ends are sorted too; two searches bound the partners.
    """
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    # a scope's offsets never mix with another's: shift each scope so that reach can't bridge two of them
    far = np.int64(max(a.max(), b.max()) + reach + 1)
    a, b = a + scope_a[:, None] * far, b + scope_b[:, None] * far
    first = np.searchsorted(b[:, 1], a[:, 0] - reach, side="left")
    return (first < len(b)) & (b[np.minimum(first, len(b) - 1), 0] <= a[:, 1] + reach)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def meets(a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
    """Which intervals of a overlap one of b, which don't overlap each other, or (whole) lie within one."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    i = np.minimum(np.searchsorted(b[:, 1], a[:, 0], side="right"), len(b) - 1)
    if whole:
        return (b[i, 0] <= a[:, 0]) & (a[:, 1] <= b[i, 1])
    return (b[i, 0] < a[:, 1]) & (a[:, 0] < b[i, 1])


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose complement is near."""
    table = lambda spans: np.array(spans, np.int64).reshape(-1, 2)
    access = table([(s, e) for k, s, e in base if k == "access"])
    has_sign = ENDPOINT_SIGN.search(text) is not None
    if not len(access) and not has_sign:
        return []
    secret = table([m.span() for m in WEAK_SECRET.finditer(text) if mixed(m[0])])
    assign, hexes = (table([(s, e) for k, s, e in base if k == x]) for x in ("assign", "hex"))
    strong = table(merged([*map(tuple, assign.tolist()), *map(tuple, hexes[~meets(hexes, access)].tolist())]))
    if not len(secret) and not len(strong):
        return []
    secret = secret[~meets(secret, strong, whole=True) & ~meets(secret, access)]
    endpoint = [m.span() for m in ENDPOINT.finditer(text)] if has_sign else []
    account = [m.span() for m in ACCOUNT.finditer(text)] if endpoint else []
    blanks = np.array([m.start() for m in BLANK_LINE.finditer(text)], np.int64)
    parts = {"a": access, "s": secret, "b": strong, "e": table(endpoint), "n": table(account)}
    scope = {k: np.searchsorted(blanks, v[:, 0]) for k, v in parts.items()}

    def by(x: str, keep: np.ndarray | None, y: str) -> np.ndarray:
        keep = np.ones(len(parts[y]), bool) if keep is None else keep
        return near(parts[x], parts[y][keep], scope[x], scope[y][keep], reach)

    kept_secret, kept_endpoint, kept_account = (np.zeros(len(parts[k]), bool) for k in "sen")
    for k in "sb":
        with_access = by(k, None, "a") & ~meets(parts[k], access)
        with_account = by(k, None, "n") & by(k, None, "e")
        if k == "s":
            kept_secret = with_access | with_account
        kept_endpoint |= by("e", with_access, k) | by("e", with_account, k)
        kept_account |= by("n", with_account, k) & by("n", None, "e")
    out: list[Span] = []
    for kind, k, keep in (("linked_secret", "s", kept_secret), ("linked_endpoint", "e", kept_endpoint), ("linked_account", "n", kept_account)):
        out += [(kind, int(s), int(e)) for s, e in parts[k][keep]]
    return out


def scan(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; each by start, then kind as listed in KINDS."""
    base = base_spans(text)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(base + linked_spans(text, base, reach), key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by the mask."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            if e > end:
                end = at = e
            continue
        out += [text[at:s], mask]
        at = end = e
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """key and spans: array of (kind, start, end) in code points, end exclusive, with base telling the base findings."""

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for t in texts(batch):
            base, every = scan(t, reach)
            own = set(base)
            out.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in every])
        return {"k": batch.column(0), "spans": out}

    kind = df.schema[key].dataType.simpleString()
    made = map_text(df.select(F.col(key).alias("k"), F.col(text).alias("text")), work, f"k {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
    return made.withColumnRenamed("k", key)


def digest_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans and all spans as text, from find_secrets()."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        key,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents with their secrets masked; n_chars, where there is one, follows the text. All rows and columns stay."""
    from .common import replace_text

    return replace_text(docs, lambda t: redact(t, scan(t)[1]))
