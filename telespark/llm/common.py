"""What the operators share: tables, the shared folder, Arrow batches and 64-bit hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised operator takes at once. A longer document is a step of its own.
STEP_BYTES = 1 << 19

#: Spark's settings of Arrow batches: name, default, and what the operators use instead of it.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1048576b"))
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed (local runs from any folder), and bound their batches.

    Rows of text are far larger than Spark's default batch of 10,000 rows expects, and a batch is in memory on both sides at once. A setting
    other than the default is left alone.
    """
    for name, default, ours in _BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    # workers share an executor's memory with the JVM: Arrow's buffers go to the heap that tidy() can give back
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in a local session one made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="telespark-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/telespark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    back = spark.read.schema(df.schema).parquet(path)
    back._telespark_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once no later step reads it."""
    if path := getattr(df, "_telespark_path", None):
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark delete the shuffle files of steps that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write one file to the shared folder; its path there."""
    path = f"{shared_dir(spark)}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(place, True)
    out.write(bytearray(data))
    out.close()
    system.deleteOnExit(place)
    return path


#: Keys that join_spread() may broadcast at most: those of over 1 / HOT_KEYS of the rows.
HOT_KEYS = 8192


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined (left or inner) with a table of distinct keys, whose ``count`` column tells how many of the ``total`` rows have the key.

    Rows of a hot key stay where they are: keys of at least total / HOT_KEYS rows are at most HOT_KEYS, whatever the data, so they are
    broadcast. All other rows are shuffled, and none of their keys can fill a task.
    """
    is_hot = F.col(count) * HOT_KEYS >= max(total, HOT_KEYS * 2)
    hot = F.broadcast(table.where(is_hot).drop(count))
    rest = rows.join(F.broadcast(table.where(is_hot).select(*on)), on, "left_anti").join(table.where(~is_hot).drop(count), on, how)
    return rows.join(hot, on).unionByName(rest)


#: Bits of a sieve at most (16 MB), and longs in a row of it.
SIEVE_BITS, SIEVE_LONGS = 1 << 27, 32


class Sieve(NamedTuple):
    """A bitmap of hashed keys. It says yes to each of its keys, and to a small share of others: under a sixteenth, more beyond SIEVE_BITS / 16 keys."""

    table: DataFrame
    bits: int

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))


def sieve(keys: DataFrame, column: str) -> Sieve:
    """A sieve of the non-null keys of one column: native aggregates, of bounded size. Lineage ends there."""
    n = keys.count()
    made = Sieve(keys, min(SIEVE_BITS, 1 << max(16, (16 * n).bit_length())))
    at = made.place(F.col(column))
    rows = keys.where(F.col(column).isNotNull()).select(F.shiftright(at, 11).alias("row"), F.shiftright(at, 6).bitwiseAND(SIEVE_LONGS - 1).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    words = rows.groupBy("row", "word").agg(F.bit_or("bit").alias("bits"))
    longs = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")) for w in range(SIEVE_LONGS)]
    return Sieve(materialise(words.groupBy("row").agg(F.array(*longs).alias("longs"))), made.bits)


def sifted(df: DataFrame, column: str, by: Sieve, held: bool = True) -> DataFrame:
    """The rows whose key the sieve says yes to, or (not held) no, as for null keys. Nothing is shuffled."""
    row, longs = fresh("_row", df), fresh("_longs", df)
    at = by.place(F.col(column))
    table = F.broadcast(by.table.select(F.col("row").alias(row), F.col("longs").alias(longs)))
    bit = F.getbit(F.col(longs)[F.shiftright(at, 6).bitwiseAND(SIEVE_LONGS - 1).cast("int")], at.bitwiseAND(63).cast("int"))
    yes = F.col(column).isNotNull() & F.coalesce(bit == 1, F.lit(False))
    joined = df.withColumn(row, F.shiftright(at, 11)).join(table, row, "inner" if held else "left")
    return joined.where(yes if held else ~yes).select(df.columns)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def bucket(col: str | Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n: the folds that the queries' contracts name."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


_SHARES = 1 << 52


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_SHARES))


def share_below(key: Column, share: float) -> Column:
    """True for a pseudo-random share of the keys, the same on every run; shares down to 2**-52 are told apart."""
    return _place(key) < int(min(1.0, share) * _SHARES)


def least_ids(n: int, most: int, rows_at: Callable[[float], DataFrame]) -> list:
    """The distinct ids of least hash, at most so many. rows_at(share) has the id of all rows of which share_below() is true; n is about their number.

    Few more ids than asked for are shuffled, however many there are; the share grows until it holds enough distinct ones.
    """
    share = 2 * most / max(n, 1)
    while True:
        ids = [r[0] for r in rows_at(share).select("id").distinct().orderBy(_place(F.col("id")), "id").limit(most).collect()]
        if len(ids) >= most or share >= 1:
            return ids
        share *= 4


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``most`` bytes of one string column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, starting at 0; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: What operators keep in a worker between tasks, by name: how to let go of it.
_STORES: dict[str, Callable[[], None]] = {}


def keeps(name: str, let_go: Callable[[], None]) -> None:
    """Tell that this worker keeps something between tasks; it is let go of when another operator uses the worker."""
    _STORES[name] = let_go


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], store: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before which the worker, which Spark keeps for later tasks, drops other operators' stores, and after which it gives free memory back."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if others := [name for name in _STORES if name != store]:
            for name in others:
                _STORES.pop(name)()
            gc.collect()
            give_back()
        yield from run(batches)
        give_back()

    return own


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, column: str = "text", store: str = "", most: int = STEP_BYTES) -> DataFrame:
    """mapInArrow over slices of about ``most`` bytes; ``work`` returns the columns of ``schema`` by name. ``store``: what it keeps between tasks, by keeps()."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, column, most):
            made = work(part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run, store), schema)


_A, _B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 of a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLD)


def replace_text(docs: DataFrame, change: Callable[[str], str], column: str = "text") -> DataFrame:
    """``docs`` with each non-null text replaced; n_chars, where there is one, becomes the new length. All rows and columns stay."""
    counted = "n_chars" in docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, column):
            new = [None if x is None else change(x) for x in part.column(column).to_pylist()]
            at = part.schema.get_field_index(column)
            part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            if counted:
                at = part.schema.get_field_index("n_chars")
                part = part.set_column(at, part.schema.field(at), pa.array([None if x is None else len(x) for x in new]).cast(part.schema.field(at).type))
            yield part

    return docs.mapInArrow(tidy(run), schema)
