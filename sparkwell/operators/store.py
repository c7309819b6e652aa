"""Tables on Parquet: keyed append, projection with equality predicates, additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pool import append_new, refreshed


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **equal: object) -> DataFrame:
    """Some columns of the rows with given values; both reach the scan."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value if value is not None else F.col(name).isNull())
    return rows.select(*columns) if columns else rows


def append(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Adds rows; with a key only those whose key the table has not, one of each. Files that are there are not rewritten."""
    if key is not None and exists(rows.sparkSession, path):
        rows = append_new(read(rows.sparkSession, path, [key]), rows, key)
    elif key is not None:
        rows = rows.dropDuplicates([key])
    rows.write.mode("append").parquet(path)


#: Bytes of a row group of a clustered table: small ones can be skipped.
ROW_GROUP_BYTES = 8 << 20
#: Ids that are pushed down to the scan as values, at most, and how many of them make one list (Spark compares longer lists by their ends alone).
PUSHED_IDS, LIST_IDS = 2000, 10


def append_clustered(rows: DataFrame, path: str, key: str, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Adds rows in ranges of ``key``, sorted, with Parquet's own Bloom filters and page indexes on it.

    Each file holds a range, so that a scan for some keys reads few files' groups
    and pages; ids that are no ranges, such as digests, are told by the filters.
    ``files``: how many, as many as the shuffle has partitions if not given.
    """
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true")
    writer.option("parquet.block.size", str(row_group_bytes)).parquet(path)


def fetch(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of wanted ids, one of each id; nulls are no ids.

    A list of at most ``PUSHED_IDS`` goes to the scan as a filter, which skips row
    groups and pages; a longer one is joined, where Spark may filter at run time.
    """
    wanted = ids.where(F.col(key).isNotNull()).select(key).distinct()
    first = sorted(r[0] for r in wanted.limit(PUSHED_IDS + 1).collect())
    rows = read(spark, path)
    if not first:
        rows = rows.where(F.lit(False))
    elif len(first) <= PUSHED_IDS:
        lists = [F.col(key).isin(first[i : i + LIST_IDS]) for i in range(0, len(first), LIST_IDS)]
        while len(lists) > 1:  # a balanced tree of alternatives
            lists = [a | b for a, b in zip(lists[::2], lists[1::2], strict=False)] + lists[len(lists) // 2 * 2 :]
        rows = rows.where(lists[0])
    else:
        rows = rows.join(wanted, key, "left_semi")
    found = rows.dropDuplicates([key])
    return found.select(*columns) if columns else found


def refresh(rows: DataFrame, path: str, target: str, key: str) -> None:
    """Writes the table at ``path`` with fresh rows in the place of old ones to another path, as no job overwrites what it reads."""
    refreshed(read(rows.sparkSession, path), rows, key).write.parquet(target)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, columns, files, bytes."""
    rows = read(spark, path)
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    return rows.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(rows.columns)).cast("long")).join(files, how="cross")  # one row each


def evolve(rows: DataFrame, declared: T.StructType) -> DataFrame:
    """Rows with every declared column: absent ones are null, those that are not declared stay at the end. A column of another type is cast."""
    has = set(rows.columns)
    known = [(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    return rows.select(*known, *[F.col(c) for c in rows.columns if c not in declared.names])
