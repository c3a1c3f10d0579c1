"""Operator 3, best-fit packing: a linear grouping scheme over the histogram of lengths.

No length exceeds the sequence length, so the plan needs only one count per length, whatever the number of documents:

1. lengths over a quarter of a sequence are large. Sorted by length they fall into groups of equal cardinality; each is rounded up to its group's largest;
2. column generation finds how often to use which configuration of the few rounded sizes (a linear programme over configurations);
3. whole uses of each configuration get actual lengths of their groups in place of the rounded sizes;
4. lengths that are left, then the small ones, go by best fit into the fullest sequence that still holds them, else into new ones.

Sequences of equal content are one template with a multiplicity, so steps 3 and 4 cost the same for any number of documents. Each
document has a rank within its length; the plan maps (length, rank) to (sequence, offset). Ranks come from a
window over (length, salt) and the counts of the salts before, so that a length that a third of the rows share is split.

Defined cases: a null text is empty and is one piece of the closing id alone; repeated rows are packed each for itself; an empty
table gives an empty table; other columns are ignored; only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps, map_text, materialise, mix64, texts, tidy

CAPACITY = 4096
#: The id that closes each document.
CLOSE = 1
GROUPS = 192
#: Lengths over this part of a sequence are large.
LARGE = 4
#: Rows of one length that one window task takes, about.
SALT_ROWS = 100_000

#: This vocabulary's pre-token pattern, as it reads for the characters that are not UNUSUAL. Those are in composed
#: form already, lower-case alike everywhere, and letters, digits and white space among them are the same to every library.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
UNUSUAL = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]|<\\|")
#: Kinds of characters to the pattern; an apostrophe before these endings is a word with them.
SPACE, LETTER, DIGIT, OTHER = range(4)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A key's 64-bit numbers, of four characters each. Longer words are tokenised anew in each step.
QUADS = 4
#: Words of a worker whose ids are kept, of which the table's slots are twice as many.
KEPT = 1 << 20
#: Bytes of text that are tokenised at once.
STEP = 1 << 20


def units(text: str) -> np.ndarray:
    """A text's UTF-16 code units."""
    return np.frombuffer(text.encode("utf-16-le"), np.uint16)


@lru_cache(maxsize=1)
def character_kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code unit, and whether it is unusual, as the patterns themselves say."""
    every = "".join(map(chr, range(1 << 16)))
    kind = np.full(1 << 16, OTHER, np.uint8)
    for k, pattern in ((SPACE, r"\s"), (LETTER, r"[^\W\d_]"), (DIGIT, r"\d")):
        kind[[ord(c) for c in re.findall(pattern, every)]] = k
    odd = np.zeros(1 << 16, bool)
    odd[[ord(c) for c in UNUSUAL.findall(every) if len(c) == 1]] = True
    return kind, odd


def plain(batch: list[str]) -> np.ndarray:
    """Whether a text's words are found here; those of the others are left to the library."""
    length = np.fromiter(map(len, batch), np.int64, len(batch))
    whole = np.fromiter(("<|" not in x for x in batch), bool, len(batch))
    text = "\n".join(batch)
    u = np.frombuffer(text.encode(), np.uint8) if text.isascii() else units(text)
    if len(u) != len(text):  # some characters take two units
        return whole & np.fromiter((UNUSUAL.search(x) is None for x in batch), bool, len(batch))
    odd = np.flatnonzero(character_kinds()[1][u])
    whole[np.searchsorted(np.cumsum(length + 1), odd, side="right")] = False
    return whole


def find_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code units of a text in lower case, the words' starts and their lengths, as WORD finds them. There is some white space after it."""
    u = units(text + " " * 4 * QUADS)
    kind = character_kinds()[0][u]
    first = np.ones(len(u), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == DIGIT
    mark = np.flatnonzero(first & (u == ord("'")))
    for ending in ENDINGS if len(mark) else ():
        here = mark[np.logical_and.reduce([u[mark + 1 + i] == ord(c) for i, c in enumerate(ending)])]
        first[here + 1] = False
        first[here + 1 + len(ending)] = True
    start = np.flatnonzero(first)
    length = np.diff(start, append=len(u))
    word = kind[start] != SPACE
    return u, start[word], length[word]


def word_keys(u: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The characters of words of at most 4 * QUADS of them, as one row of numbers each; no other word has the same."""
    four = u[:-3].astype(np.uint64)
    for i in range(1, 4):
        four |= u[i : len(u) - 3 + i].astype(np.uint64) << np.uint64(16 * i)
    mask = np.array([(1 << 16 * i) - 1 for i in range(5)], np.uint64)
    keys = np.zeros((len(start), QUADS), np.uint64)
    keys[:, 0] = four[start] & mask[np.minimum(length, 4)]
    for q in range(1, QUADS):
        more = np.flatnonzero(length > 4 * q)
        keys[more, q] = four[start[more] + 4 * q] & mask[np.minimum(length[more] - 4 * q, 4)]
    return keys


def same_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).view(np.uint32)[:, 0] == np.uint32(0x01010101)


class WordTable:
    """Numbers of words by their keys: slots of which a word takes the first free one from where its hash points."""

    def __init__(self, most: int) -> None:
        self.slots = np.full(2 * most, -1, np.int32)
        self.keys = np.empty((most, QUADS), np.uint64)
        self.n = 0

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = mix64(keys[:, 0])
        for q in range(1, QUADS):
            more = np.flatnonzero(keys[:, q])
            h[more] = mix64(h[more] ^ keys[more, q])
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those that are not here."""
        at = self.place(keys)
        entry = self.slots[at]
        left = np.flatnonzero((entry >= 0) & ~same_rows(self.keys[entry], keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            entry[left] = now = self.slots[at[left]]
            left = left[(now >= 0) & ~same_rows(self.keys[now], keys[left])]
        return entry

    def add(self, keys: np.ndarray) -> None:
        """Number different words that are not here, in their order."""
        self.keys[self.n : self.n + len(keys)] = keys
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = self.n + free  # of those that want one slot, one gets it
            left = left[self.slots[at[left]] != self.n + left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.n += len(keys)


def ragged(pool: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of a pool in a row."""
    ends = np.cumsum(n, dtype=np.int64)
    return pool[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Store:
    """Token ids of words: a table of their numbers, and where in one pool each one's ids are."""

    def __init__(self, most: int) -> None:
        self.table = WordTable(most)
        self.start, self.length = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.uses = np.zeros(most, np.int32)
        self.pool, self.filled = np.empty(1 << 12, np.uint32), 0

    def put(self, ids: np.ndarray) -> None:
        """Ids after the last ones that are kept. They are overwritten later unless keep() is told their words."""
        n = self.filled + len(ids)
        if n > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.filled], np.empty(max(n, 2 * len(self.pool)) - self.filled, np.uint32)))
        self.pool[self.filled : n] = ids

    def keep(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Keep different words, whose ids were the first put, as far as there is room."""
        at = self.table.n
        n = n[: len(self.start) - at]
        self.table.add(keys[: len(n)])
        self.start[at : at + len(n)] = self.filled + np.cumsum(n) - n
        self.length[at : at + len(n)] = n
        self.uses[at : at + len(n)] = 1
        self.filled += int(n.sum())

    def thinned(self) -> Store:
        """A store of the half of the words that were in most steps; none of those met in no step since the last time."""
        most, now = len(self.start), self.table.n
        stay = np.argsort(-self.uses[:now], kind="stable")[: most // 2]
        stay = stay[self.uses[stay] > 0]
        new = Store(most)
        new.put(ragged(self.pool, self.start[stay], self.length[stay]))
        new.keep(self.table.keys[stay], self.length[stay])
        new.uses[:] = 0
        return new


class WordTokenizer:
    """Token ids of texts as the tokenizers library gives them, with each different word tokenised once.

    The normaliser and the pattern look at no character outside a word, so a text's ids are its words' ids in a row.
    Words are found and looked up in arrays, all of a step at once; only new or long ones become strings.
    Texts with unusual characters or special tokens go to the library whole.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.store = Store(kept)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in a row and their numbers, from texts of many words each: a word's last token alone has the mark of a word's end."""
        parts = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)], add_special_tokens=False)]
        made = np.concatenate(parts)
        n = np.diff(np.flatnonzero(self.ends[made]), prepend=-1)
        if len(n) != len(words) or n.sum() != len(made):
            single = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
            n = np.fromiter(map(len, single), np.int64, len(single))
            made = np.fromiter((i for x in single for i in x), np.uint32, int(n.sum()))
        return made, n

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of a text in lower case start, how many ids each has, and all ids in a row."""
        if 4 * self.store.table.n > 3 * len(self.store.start):
            self.store = self.store.thinned()
        store = self.store
        u, at, size = find_words(text)
        short = size <= 4 * QUADS
        keys = word_keys(u, at[short], size[short])
        entry = store.table.find(keys)
        missed = np.flatnonzero(entry < 0)
        store.uses[entry[entry >= 0]] += 1  # once, however often a word is in the step
        start, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[short], n[short] = store.start[entry], store.length[entry]
        where = np.concatenate((np.flatnonzero(short)[missed], np.flatnonzero(~short)))
        if not len(where):
            return at, n, ragged(store.pool, start, n)
        codes: dict[str, int] = {}
        code = np.array([codes.setdefault(text[a : a + k], len(codes)) for a, k in zip(at[where].tolist(), size[where].tolist(), strict=True)])
        made, new_n = self.learn(list(codes))
        store.put(made)
        start[where], n[where] = (store.filled + np.cumsum(new_n) - new_n)[code], new_n[code]
        ids = ragged(store.pool, start, n)
        which = np.unique(code[: len(missed)], return_index=True)[1]  # the words short enough for a key, which come first
        store.keep(keys[missed[which]], new_n[: len(which)])
        return at, n, ids

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        here = plain(batch)
        low = [x.lower() for x, own in zip(batch, here.tolist(), strict=True) if own]
        edge = np.cumsum([0] + [len(x) + 1 for x in low])
        at, n, ids = self.words("\n".join(low))
        bounds = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, edge)].tolist()
        found = (ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
        odd = [batch[i] for i in np.flatnonzero(~here)]
        whole = (np.array(x.ids, np.uint32) for x in (self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else ()))
        return [next(found if own else whole) for own in here.tolist()]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, close: int = CLOSE, with_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if wanted, the token ids."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        keeps("packing", tokenizer.cache_clear)
        for i, own in enumerate(tokenizer(path)(texts(batch))):
            own = np.append(own, np.uint32(close)).astype("<u4")
            for p, a in enumerate(range(0, len(own), capacity)):
                part = own[a : a + capacity]
                for to, x in ((row, i), (piece, p), (start, a), (length, len(part)), (crc, zlib.crc32(part.tobytes()))):
                    to.append(x)
                if with_ids:
                    ids.append(part.astype(np.int32))
        return {"k": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc} | ({"ids": ids} if with_ids else {})

    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_text(df.select(F.col(key).alias("k"), F.col(text).alias("text")), work, schema, store="packing", most=STEP).withColumnRenamed("k", key)


class Template(NamedTuple):
    """``times`` sequences of equal content: (length, number in a row) from the front."""

    times: int
    items: tuple[tuple[int, int], ...]
    room: int


def equal_groups(counts: np.ndarray, cut: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, runs of [length, count], longest first) of each group of large lengths; groups of one size are one."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > cut][::-1]
    total = int(counts[lengths].sum())
    made: list[tuple[int, list[list[int]]]] = []
    if not total:
        return made
    per, filled = -(-total // groups), 0
    for n in lengths.tolist():
        left = int(counts[n])
        while left:
            space = per - filled
            if not made or not space:
                if not made or made[-1][0] != n:
                    made.append((n, []))
                filled, space = 0, per
            take = min(left, space)
            runs = made[-1][1]
            if runs and runs[-1][0] == n:
                runs[-1][1] += take
            else:
                runs.append([n, take])
            left, filled = left - take, filled + take
    return made


def best_configuration(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the greatest total value: one layer of the table for each item more."""
    most = capacity // int(size.min())
    best = np.zeros(capacity + 1)
    came = []
    for _ in range(most):
        now, item = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(size.tolist()):
            to = best[: capacity + 1 - s] + value[i]
            better = to > now[s:] + 1e-12
            now[s:][better] = to[better]
            item[s:][better] = i
        came.append(item)
        best = now
    use, at = np.zeros(len(size), np.int64), capacity
    for item in reversed(came):
        if item[at] >= 0:
            use[item[at]] += 1
            at -= int(size[item[at]])
    return float(use @ value), use


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how many whole sequences use each, from the linear programme's optimum."""
    n = len(size)
    basis = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        amount = (inverse * demand).sum(axis=1)
        gain, column = best_configuration(inverse.sum(axis=0), size, capacity)
        if gain <= 1 + 1e-7:
            break
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
    amount = np.maximum((inverse * demand).sum(axis=1), 0)
    if np.abs((basis * amount).sum(axis=1) - demand).max() > 1e-6 * demand.max():  # the inverse has drifted
        amount = np.maximum(np.linalg.solve(basis, demand), 0)
    uses = [(np.round(basis[:, j]).astype(np.int64), int(np.floor(amount[j] + 1e-6))) for j in range(n)]
    return [(column, times) for column, times in uses if times > 0]


def plan_templates(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, cut: int | None = None) -> list[Template]:
    """Templates that hold exactly counts[n] documents of each length n."""
    counts = np.asarray(counts, np.int64).copy()
    cut = capacity // LARGE if cut is None else cut
    templates: list[Template] = []
    if full := int(counts[capacity]):
        templates.append(Template(full, ((capacity, 1),), 0))
        counts[capacity] = 0
    if grouped := equal_groups(counts, cut, groups):
        size = np.array([g[0] for g in grouped])
        demand = np.array([sum(c for _, c in g[1]) for g in grouped])
        queues = [g[1] for g in grouped]
        for column, times in sorted(configurations(size, demand, capacity), key=lambda x: -int(x[0] @ size)):
            slots = [g for g in range(len(size)) for _ in range(int(column[g]))]
            fit = min((sum(c for _, c in queues[g]) // int(column[g]) for g in set(slots)), default=0)
            templates += substitute(queues, slots, min(times, fit), capacity)
        counts[cut + 1 :] = 0
        for queue in queues:
            for n, c in queue:
                counts[n] += c
    return best_fit(templates, counts, capacity)


def substitute(queues: list[list[list[int]]], slots: list[int], times: int, capacity: int) -> list[Template]:
    """Each slot of ``times`` sequences takes actual documents of its group; a template ends where any slot's length changes."""
    taken: list[list[tuple[int, int]]] = []
    for g in slots:
        need, got, queue = times, [], queues[g]
        while need:
            n, c = queue[0]
            take = min(need, c)
            got.append((n, take))
            need -= take
            if take == c:
                queue.pop(0)
            else:
                queue[0][1] -= take
        taken.append(got)
    edges = sorted({0, *(int(e) for got in taken for e in np.cumsum([c for _, c in got]))})
    made, where = [], [0] * len(taken)
    ends = [np.cumsum([c for _, c in got]).tolist() for got in taken]
    for a, b in zip(edges, edges[1:], strict=False):
        own: dict[int, int] = {}
        for s, got in enumerate(taken):
            while ends[s][where[s]] <= a:
                where[s] += 1
            own[got[where[s]][0]] = own.get(got[where[s]][0], 0) + 1
        items = tuple(sorted(own.items(), reverse=True))
        made.append(Template(b - a, items, capacity - sum(n * c for n, c in items)))
    return made


def best_fit(templates: list[Template], counts: np.ndarray, capacity: int) -> list[Template]:
    """Place the lengths that are left, longest first, each into a fullest sequence that still holds it."""
    rooms: list[list[Template]] = [[] for _ in range(capacity + 1)]
    for t in templates:
        rooms[t.room].append(t)
    some = np.array([bool(x) for x in rooms])

    def put(t: Template) -> None:
        rooms[t.room].append(t)
        some[t.room] = True

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = int(np.argmax(some[n:])) + n
            if some[at]:
                old = rooms[at].pop()
                some[at] = bool(rooms[at])
            else:
                at, old = capacity, Template(left, (), capacity)
            per = at // n
            whole = min(old.times, left // per)
            if whole:
                put(Template(whole, (*old.items, (n, per)), at - per * n))
                left -= whole * per
            rest = old.times - whole
            if rest and left and left < per:
                put(Template(1, (*old.items, (n, left)), at - left * n))
                left, rest = 0, rest - 1
            if rest and old.items:
                put(Template(rest, old.items, old.room))
    return [t for r in rooms for t in r]


class Plan(NamedTuple):
    """For each run of documents of one length, in order of (length, first rank): where they go."""

    key: np.ndarray  # length * 2**44 + first rank
    per: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


SHIFT = 44


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    for t in plan_templates(counts, capacity, groups):
        at = 0
        for n, per in t.items:
            rows.append((n, t.times * per, per, base, at))
            at += n * per
        base += t.times
    rows.sort(key=lambda r: r[0])
    x = np.array(rows, np.int64).reshape(-1, 5)
    before = np.cumsum(x[:, 1]) - x[:, 1]
    first = before - before[np.searchsorted(x[:, 0], x[:, 0])] if len(x) else before
    return Plan((x[:, 0] << SHIFT) + first, x[:, 2], x[:, 3], x[:, 4], base)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the documents of these lengths and ranks."""
    if not len(length):
        return length, rank
    at = np.searchsorted(p.key, (length << SHIFT) + rank, side="right") - 1
    nth = rank - (p.key[at] - (length << SHIFT))
    return p.base[at] + nth // p.per[at], p.offset[at] + nth % p.per[at] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to written pieces (each step here reads them again, so pass a table, not a lazy tokenisation).

    The driver gets one count per length (at most ``capacity``), and the executors a plan that length bounds.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    made = spark.sparkContext.broadcast(plan(counts, capacity, groups))
    salts = max(16, -(-int(counts.max()) // SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")))
    ranked = ranked.join(before.drop("count"), ["length", "_salt"]).withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_nth") - 1)
    ranked = ranked.select(*pieces.columns, F.col("_rank").cast("long").alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                seq, off = place(made.value, b.column("length").to_numpy(), b.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in pieces_columns), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*pieces_columns, "sequence_id", "offset"])

    pieces_columns = pieces.columns
    return ranked.mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise whole documents, cut the longest, and pack the pieces."""
    return pack(materialise(token_pieces(docs, path, capacity, with_ids=with_ids)), capacity)
