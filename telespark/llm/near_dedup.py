"""Operator 6, MinHash near-dedup: SuperMinHash signatures, banding, exact verification and union-find grouping.

1. Every document's set of word shingles is hashed to 64 bits and signed by SuperMinHash (SLOTS slots, BANDS bands).
2. Documents of equal sets are one class; its least doc_id stands for it. Copies are never expanded into pairs.
3. A band key that several classes share is a bucket; its pivot is the member that meets most others over all its buckets. Members
   near their pivot (by a sketch of two bits per slot) are verified against it on full sets and keep what sets them off from it.
4. Members of one star that are still in different components are all compared, exactly, by those differences, inside the
   join: only links leave it. All other pairs of a bucket that are still apart are verified on full sets, unless their sketches lie
   over five standard deviations under the threshold. No bucket is capped.
5. Components by union-find within partitions and star contraction between them.

Recall: a pair of similarity s shares a bucket with probability 1 - (1 - s**5)**32: at s = 0.8, 0.999997. A link is reported only
if the exact sets pass 100 * intersection >= 80 * union.

Defined cases: a null text or one without words has an empty set and links with nothing; rows with one doc_id are one document for
linking, each row returned with its own set size; rows with a null doc_id link with nothing and have a null component and are kept;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_spread, map_text, materialise, mix64, sieve, sifted, sweep, utf8
from .components import components
from .superminhash import band_keys, signatures, sketches
from .words import hashed_words, shingle_sets

SLOTS, BANDS = 160, 32
WORDS = 5
PERCENT = 80
#: Unlike bits of 320 at which a pair isn't verified any more: 32 are expected at similarity 0.8, with a deviation of 6.5.
FAR_BITS = 67
#: Unlike bits up to which a member counts as near its pivot (similarity 0.4). Which side a pair falls on doesn't alter the result.
NEAR_BITS = 96
#: Members of a star that one task compares with the others.
STAR_TASK = 400
#: Pairs of one document that one task verifies.
PIVOT_TASK = 256
_SKETCH = [f"s{i}" for i in range(2 * SLOTS // 64)]


def signed(docs: DataFrame, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, n_shingles, two hashes of the whole set, band keys and sketch of each row."""

    def work(batch: pa.RecordBatch) -> dict:
        elements, bounds = shingle_sets(hashed_words(*utf8(batch.column("text"))), words)
        sign = signatures(elements, bounds, SLOTS)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sign) + 1, BANDS, dtype=np.int32)), pa.array(band_keys(sign, BANDS).ravel().view(np.int64)))
        out = {"id": batch.column(0), "n_shingles": np.diff(bounds), "keys": keys}
        for i, salt in enumerate((0x5DEECE66D, 0x2545F4914F6CDD1D)):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(elements ^ np.uint64(salt)))))
            out[f"h{i}"] = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
        return out | {c: x for c, x in zip(_SKETCH, np.ascontiguousarray(sketches(sign).view(np.int64).T), strict=True)}

    schema = "id long, n_shingles long, keys array<long>, h0 long, h1 long, " + ", ".join(f"{c} long" for c in _SKETCH)
    return map_text(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), work, schema)


def shingle_table(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id and its set as sorted hashes."""

    def work(batch: pa.RecordBatch) -> dict:
        elements, bounds = shingle_sets(hashed_words(*utf8(batch.column("text"))), words)
        return {"id": batch.column(0), "items": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))}

    return map_text(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), work, "id long, items array<long>")


def dealt(pairs: DataFrame, most: int = PIVOT_TASK) -> DataFrame:
    """Pairs (a, b) with the tasks that the pairs of their a are dealt among, and the task of each."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("tasks", F.ceil(F.col("n") / most).cast("int"))
    return join_spread(pairs, sizes, ["a"], "n", pairs.count()).withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int"))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, with their sets x, y. An a of many pairs is copied to each of its tasks; b's are spread by themselves.

    Pairs and sets grow alike, so neither is ever broadcast: the plan is the same at every size.
    """
    placed = dealt(pairs)
    right = placed.join(sets.hint("merge").select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    left = placed.select("a", "tasks").distinct().join(sets.hint("merge").select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    left = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    return right.hint("merge").join(left, ["a", "task"])


def similar(shared: Column, total: Column, percent: int) -> Column:
    """Whether sets with so many shared elements, of ``total`` in both counts together, are similar enough."""
    return shared * 100 >= (total - shared) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, a written table, that full sets confirm; only the sets that occur in pairs are shuffled."""
    needed = sieve(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    both = with_sets(pairs, sifted(sets, "id", needed))
    return both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y"), percent)).select("a", "b")


def unlike_bits(prefix: str) -> Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{prefix}{c}"))) for c in _SKETCH), F.lit(0))


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def star_links(stars: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Links between members of one star that are in different components, exactly, from what sets them off from their pivot.

    With m the pivot's elements that a member lacks and e its own extra ones, two members share
    |pivot| - |m1 or m2| + |e1 and e2| elements. A star of n members is dealt among n / STAR_TASK tasks.
    """
    labelled = labels(stars, roots).drop("linked")
    sizes = labelled.groupBy("p").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    sizes = sizes.select("p", "m", F.ceil(F.col("m") / STAR_TASK).cast("int").alias("tasks"))
    open_stars = join_spread(labelled, sizes, ["p"], "m", stars.count(), "inner")
    size, total = F.col("pivot_size"), F.col("n") + F.col("l_n")
    most = size - F.greatest(F.size("lacks"), F.size("l_lacks")) + F.least(F.size("extra"), F.size("l_extra"))
    shared = size - F.size(F.array_union("lacks", "l_lacks")) + F.size(F.array_intersect("extra", "l_extra"))
    return met_pairs(open_stars, ["p"], (F.col("l_c") != F.col("c")) & similar(most, total, percent) & similar(shared, total, percent))


def met_pairs(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Pairs (a, b), a < b, of rows of one key that meet the condition, which is tested inside the join: only they leave it.

    A key's rows are dealt among their ``tasks``: each is the left side of one task, and the right side of all.
    """
    left = renamed(rows.withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")), "l_")
    right = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    met = (F.col("l_task") == F.col("task")) & (F.col("l_id") < F.col("id")) & condition
    for k in keys:
        met = (F.col(f"l_{k}") == F.col(k)) & met
    return left.join(right, met).select(F.col("l_id").alias("a"), F.col("id").alias("b")).distinct()


def labels(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("c", F.col("id"))
    return rows.join(roots, "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(id, items), written, of the wanted ids and a few others: a sieve picks the texts where they lie, so none is shuffled."""
    ids = fresh("_id", docs)
    keyed = docs.withColumn(ids, F.col(key).cast("long"))
    sets = materialise(shingle_table(sifted(keyed, ids, sieve(wanted, "id")), words, text, ids))
    repeated = sets.groupBy("id").count().where("count > 1").select("id")
    if repeated.isEmpty():
        return sets
    # repeated rows of one id: one of each set
    again = materialise(repeated)
    some = sieve(again, "id")
    once = sifted(sets, "id", some, held=False).union(sifted(sets, "id", some).groupBy("id", F.xxhash64("items").alias("h")).agg(F.min("items").alias("items")).select("id", "items"))
    made = materialise(once)
    discard(sets)
    return made


def linked_classes(stand: DataFrame, classed: DataFrame, docs: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    """(id, root) of the classes' representatives that are linked with another class; stand has their keys and sketches."""
    banded = stand.select("id", F.explode("keys").alias("key"))
    shared = materialise(banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    met = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    member = materialise(join_spread(sifted(banded, "key", sieve(shared, "key")), shared.withColumn("met", F.col("n")), ["key"], "n", met, "inner").select("key", "id", F.col("met").alias("n")))
    discard(shared)
    wanted = materialise(member.select("id").distinct())
    sets = sets_of(docs, wanted, words, text, key)
    sketch = materialise(sifted(stand, "id", sieve(wanted, "id")).select("id", *_SKETCH).distinct())
    # the classes of one doc_id's texts are one document's
    links = materialise(classed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"))
    roots = None if links.isEmpty() else materialise(components(links))

    # stars: each bucket's pivot is the member that meets most others over all its buckets
    hub = member.groupBy("id").agg(F.sum("n").alias("met"))
    pivots = member.join(hub, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("p"))).alias("top"), F.max("n").alias("n")).select("key", "n", (-F.col("top.p")).alias("p"))
    starred = materialise(join_spread(member, pivots, ["key"], "n", met, "inner"))
    for done in (member, wanted):
        discard(done)
    sweep(docs.sparkSession)
    pairs = materialise(starred.select("p", "id").distinct().where("p <> id"))
    sizes = pairs.groupBy("p").agg(F.count("*").alias("m"))
    pivot_sketch = sizes.join(renamed(sketch, "p_"), F.col("p") == F.col("p_id")).drop("p_id")
    near = join_spread(pairs, pivot_sketch, ["p"], "m", pairs.count(), "inner").join(sketch, "id").where(unlike_bits("p_") <= NEAR_BITS)
    near = materialise(near.select(F.col("p").alias("a"), F.col("id").alias("b")).distinct())
    rows = with_sets(near, sets)
    total = F.size("x") + F.size("y")
    stars = materialise(
        rows.withColumn("extra", F.array_except("y", "x")).select(
            F.col("a").alias("p"),
            F.col("b").alias("id"),
            F.size("y").alias("n"),
            F.size("x").alias("pivot_size"),
            "extra",
            F.array_except("x", "y").alias("lacks"),
            similar(F.size("y") - F.size("extra"), total, percent).alias("linked"),
        )
    )
    for done in (pairs, near):
        discard(done)
    sweep(docs.sparkSession)

    def grown(found: DataFrame) -> None:
        nonlocal links, roots
        found = materialise(found)
        if not found.isEmpty():
            links = links.union(found)
            roots = materialise(components(links))

    grown(stars.where("linked").select(F.col("p").alias("a"), F.col("id").alias("b")))
    grown(star_links(stars, roots, percent))
    # pairs of a bucket that are not both near its pivot
    labelled = labels(starred, roots)
    apart = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("key", "m", F.ceil(F.col("m") / STAR_TASK).cast("int").alias("tasks"))
    close = stars.select("p", "id", F.lit(True).alias("close")).distinct()
    rest = join_spread(labelled, apart, ["key"], "m", met, "inner").join(close, ["p", "id"], "left").withColumn("close", F.coalesce("close", F.col("p") == F.col("id"))).join(sketch, "id")
    rest = materialise(rest.select("key", "id", "c", "close", "tasks", *_SKETCH))
    pairs = materialise(met_pairs(rest, ["key"], (F.col("l_c") != F.col("c")) & ~(F.col("l_close") & F.col("close")) & (unlike_bits("l_") <= FAR_BITS)))
    for done in (rest, starred, stars, sketch):
        discard(done)
    grown(verified(pairs, sets, percent))
    for done in (sets, pairs):
        discard(done)
    sweep(docs.sparkSession)
    return links.toDF("id", "root") if roots is None else roots


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id and kept of every row of docs."""
    signs = materialise(signed(docs, words, text, key))
    usable = signs.where("id is not null and n_shingles > 0")
    of = ["h0", "h1", "n_shingles"]
    classes = materialise(usable.groupBy(*of).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    narrow = usable.select("id", *of)
    rows = join_spread(narrow, classes, of, "n", signs.count()).withColumn("rep", F.coalesce("rep", "id"))
    # one row for each class stands for it; a copy's signature goes no further
    copies = materialise(rows.where("id <> rep").select("id", "h0", "h1").distinct())
    rows = materialise(rows.select("id", "n_shingles", "rep").union(signs.where("id is null or n_shingles = 0").select("id", "n_shingles", F.lit(None).cast("long").alias("rep"))))
    some = sieve(copies, "h0")
    wide = usable.select("id", "h0", "h1", "keys", *_SKETCH)
    unique = sifted(wide, "h0", some, held=False).union(sifted(wide, "h0", some).join(copies, ["id", "h0", "h1"], "left_anti").select(wide.columns))
    stand = materialise(unique.drop("h0", "h1"))
    for done in (signs, classes, copies):
        discard(done)
    sweep(docs.sparkSession)
    roots = linked_classes(stand, rows.where("rep is not null"), docs, words, percent, text, key)
    discard(stand)
    component = F.coalesce("root", "rep", "id")
    named = roots.select(F.col("id").alias("rep"), "root")
    if named.isEmpty():
        rows = rows.withColumn("root", F.lit(None).cast("long"))
    else:
        sizes = rows.where("rep is not null").groupBy("rep").agg(F.count("*").alias("n"))
        rows = join_spread(rows, named.join(sizes, "rep"), ["rep"], "n", rows.count())
    rows = rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``gone``, a written table of keys. Only rows that a sieve takes for gone are shuffled to make sure."""
    held = sieve(gone, key)
    return sifted(docs, key, held, held=False).union(sifted(docs, key, held).join(gone, key, "left_anti").select(docs.columns))


def distinct_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with all its columns: the least key's. Rows without a key stay.

    Of rows that repeat key and text, the one with the least hash of its columns stays; rows of one key with different texts are parts of one
    document, which stays or goes whole.
    """
    groups = near_groups(docs, words, percent, text, key)
    gone = materialise(groups.where("not kept").select(key).distinct())
    kept = without(docs, gone, key)
    repeated = materialise(docs.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).select(key))
    if repeated.isEmpty():
        return kept
    some = sieve(repeated, key)
    whole = F.struct(*(F.col(c) for c in docs.columns))
    one = sifted(kept, key, some).groupBy(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("s")).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return sifted(kept, key, some, held=False).union(one.select("row.*"))
