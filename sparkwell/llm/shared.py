"""Helpers that the operators of this folder share.

* scratch space that driver and executors both see,
* lookups that keep one hot key from landing in one task,
* ranks inside hot groups without a window over the whole group,
* zero-copy access to the UTF-8 bytes of an Arrow string column.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Used only by a local session that names no shared folder (as in tests).
LOCAL_SCRATCH = "/tmp/checkpoints/sparkwell"
#: At most this many keys are called hot, whatever the size of the input.
MAX_HOT_KEYS = 1000
#: A keyed table is broadcast up to about so many bytes of a hash table; beyond, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Narrow rows for which a stored table gets a file more.
ROWS_A_FILE = 50_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/sparkwell"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """The tables of one run of an operator, under a folder of its own in the shared folder.

    Storing a frame cuts its lineage and survives lost executors. A table goes as
    soon as nothing that is still to run reads it (``drop``); those that the
    operator's result reads stay until ``close``, which is the caller's.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.base = spark, scratch_path(spark, tag)
        self.tables: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str, rows: int | None = None, compression: str = "zstd") -> DataFrame:
        """Write and read again. ``rows``: a bound on the number of narrow rows; the table gets no more tasks and files than these need."""
        path = f"{self.base}/{len(self.tables)}-{name}"
        out = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        out.write.option("compression", compression).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *frames: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is f for f in frames):
                delete_path(self.spark, path)

    def keep_only(self, *frames: DataFrame) -> None:
        self.drop(*(t for t, _ in self.tables if not any(t is f for f in frames)))

    def close(self) -> None:
        delete_path(self.spark, self.base)


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """A frame stored in the shared folder, apart from any operator's run."""
    return Scratch(df.sparkSession, tag).store(df, tag, compression=compression)


def row_bytes(schema: T.StructType) -> int:
    """About what a row of numbers and digests takes in a hash table."""
    sizes = [row_bytes(f.dataType) if isinstance(f.dataType, T.StructType) else 48 if isinstance(f.dataType, T.BinaryType | T.StringType) else 8 for f in schema]
    return 48 + sum(sizes)


def is_small(df: DataFrame) -> bool:
    """Whether a stored narrow frame takes at most ``BROADCAST_BYTES`` when broadcast."""
    most = BROADCAST_BYTES // row_bytes(df.schema)
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a stored narrow frame whose row count was checked; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if is_small(df) else df


def hot_threshold(total: int) -> int:
    """Group size above which a key is hot. At most ``MAX_HOT_KEYS`` keys of ``total`` rows can exceed it."""
    return max(total // MAX_HOT_KEYS, 500)


def lookup(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows LEFT JOIN groups USING (key)`` where one key may hold a third of all rows.

    ``groups``, a stored frame, has one row per key and the number of ``rows``
    with it in column ``count``. The hot keys, at most ``MAX_HOT_KEYS`` by
    construction, are joined by broadcast; the rest by shuffle, where no key has
    more than ``hot_threshold(total)`` rows. Where no key is hot, the join is a
    plain one. ``rows`` should be stored, as they may be read twice.
    """
    limit = hot_threshold(total)
    hot = groups.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(groups, key, "left")
    first = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(count) <= limit), key, "left")
    return first.unionByName(rest)


#: Bits of a bitmap of hashes, at most 16 MB whatever the number of keys.
BITMAP_BITS, _PAGE_BITS = 27, 15


def perhaps_in(rows: DataFrame, keys: DataFrame, row_key: list[F.Column], key: list[str], mark: str) -> DataFrame:
    """``rows`` with a column ``mark``: false where the key is surely not among ``keys``.

    The hashes of all keys are bits of a bitmap, whose pages go to every task. So
    only rows that may have a partner are shuffled for a join, whatever is in them.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(1 << BITMAP_BITS))
    of_page = lambda p: F.shiftright(p, _PAGE_BITS).cast("int")
    within = lambda p: p.bitwiseAND(F.lit((1 << _PAGE_BITS) - 1)).cast("int")
    placed = keys.select(place([F.col(k) for k in key]).alias("_place"))
    pages = placed.groupBy(of_page(F.col("_place")).alias("_page")).agg(F.bitmap_construct_agg(within(F.col("_place"))).alias("_bits"))
    at = within(F.col("_place"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = rows.withColumn("_place", place(row_key)).withColumn("_page", of_page(F.col("_place"))).join(F.broadcast(pages), "_page", "left")
    hit = F.col("_bits").isNotNull() & (F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1)
    return seen.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("_place", "_page", "_bits")


def matching(rows: DataFrame, keys: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows JOIN keys USING (key)``: by broadcast where the keys are few, else as ``lookup`` does, for which ``keys`` tells in ``count`` how many rows each may have.

    Rows that have no partner are not shuffled.
    """
    if is_small(keys):
        return rows.join(F.broadcast(keys), key)
    likely = perhaps_in(rows, keys, [F.col(key)], [key], "_hit").where("_hit").drop("_hit")
    return lookup(likely, keys, key, total, count).where(F.col(count).isNotNull())


def numbered(rows: DataFrame, group: str, order: list[str], total: int, out: str) -> DataFrame:
    """Number the rows of every group from 0, gapless, where groups may be hot.

    Rows are dealt into buckets by a hash of ``order``, which tells repeated rows
    apart too (by their place in the stored frame, say); the counts of (group,
    bucket) give each bucket its first number, and a window numbers inside the
    bucket only. A bucket holds about 20,000 rows, whatever key is hot.
    ``rows`` should be stored, as it is read twice.
    """
    buckets = max(16, -(-total // 20_000))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    # the counts are as many as groups times buckets: the window over them is over a small table
    w = W.Window.partitionBy(group).orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select(group, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inner = W.Window.partitionBy(group, "_b").orderBy(*order)
    return (
        dealt.withColumn("_r", F.row_number().over(inner) - 1)
        .join(bases, [group, "_b"])
        .withColumn(out, (F.col("_base") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_base")
    )


def column_name(df: DataFrame, name: str) -> str:
    """The frame's own spelling of a column that the session resolves without regard to case."""
    return name if name in df.columns else next((c for c in df.columns if c.lower() == name.lower()), name)


def clean_text(name: str = "text") -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, without copying; null rows are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_STATE: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a worker process from task to task, such as a vocabulary; one operator's at a time."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def release_memory(keep: object = None) -> None:
    """At the end of a task: drop what other operators keep, and give freed memory back to the system, so that idle workers do not add up."""
    for key in [k for k in _STATE if k != keep]:
        del _STATE[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(offsets: np.ndarray, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` each: bounds the memory of vectorised steps; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def pieces(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``max_bytes`` bytes of one of its string columns, without copying."""
    _, offsets = utf8(batch.column(column))
    for i, j in slices(offsets, max_bytes):
        yield batch.slice(i, j - i)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def schema_of(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields)
