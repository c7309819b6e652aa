"""Repertoire data units (a JSON line, then CSV, perhaps gzipped) and Parquet shards by study."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..operators.pool import normalize

ROOT = "https://opig.stats.ox.ac.uk/webapps/ngsdb"


def unit_url(study: str, filename: str, paired: bool = False) -> str:
    return f"{ROOT}/{'paired' if paired else 'unpaired'}/{study}/csv/{filename}"


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The JSON object on the first line, which is one CSV cell."""
    line = _first_lines(spark, path, 1)[0]
    cell = next(csv.reader(io.StringIO(line)))
    return json.loads(cell[0] if len(cell) == 1 else line)


def read_unit(spark: SparkSession, path: str) -> DataFrame:
    """All columns of one unit as text. A gzipped unit is one task to read; it is dealt anew afterwards."""
    meta, header = _first_lines(spark, path, 2)
    names = next(csv.reader(io.StringIO(header)))
    lines = spark.read.text(path).where(~F.col("value").isin(meta, header))
    schema = ", ".join(f"`{n}` string" for n in names)
    if path.endswith(".gz"):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    parsed = lines.select(F.from_csv("value", schema, {"escape": '"'}).alias("r"))
    blank = [F.nullif(F.col(f"r.`{n}`"), F.lit("")).alias(n) for n in names]
    return parsed.select(*blank)


def load_unit(spark: SparkSession, path: str, keep: Filter | None = None, limit: int | None = None) -> tuple[DataFrame, dict[str, str], Observation, Observation]:
    """(rows, metadata, scanned, kept): read, normalise, filter; rows of one id once.

    The last two are filled with ``rows`` by the first action on the frame: how many rows were
    read and how many passed the filter. The funnel is ``keep.explain`` of the
    normalised rows, over the whole input.
    """
    meta, scanned, kept = read_metadata(spark, path), Observation("rows_scanned"), Observation("rows_kept")
    raw = read_unit(spark, path).observe(scanned, F.count(F.lit(1)).alias("rows"))
    rows = (keep or Filter()).apply(normalize(raw, meta, path.rsplit("/", 1)[-1])).observe(kept, F.count(F.lit(1)).alias("rows"))
    return (rows.limit(limit) if limit else rows).dropDuplicates(["seq_id"]), meta, scanned, kept


def list_files(spark: SparkSession, root: str, chain: str = "heavy") -> DataFrame:
    """(study, path) of every shard under ``root/chain/study``; the folder's listing only, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/{chain}").select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("study"), "path")


def list_studies(spark: SparkSession, root: str, chain: str = "heavy") -> DataFrame:
    """(study, shards): the studies under ``root/chain`` as they are spelled there."""
    return list_files(spark, root, chain).groupBy("study").agg(F.count("*").alias("shards"))


def study_files(spark: SparkSession, root: str, study: str, chain: str = "heavy") -> list[str]:
    """Shards of a study under ``root/chain``; its name is matched without regard to case and punctuation."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    named = list_files(spark, root, chain)
    found = [r["path"] for r in named.where(plain(F.col("study")) == plain(F.lit(study))).orderBy("path").collect()]
    if not found:
        raise KeyError(f"no study {study!r} under {root}/{chain}")
    return found


def read_shards(spark: SparkSession, paths: list[str], columns: list[str] | None = None, species: str | None = None) -> DataFrame:
    """Several shards as one frame; wanted columns that are absent are left out; the species is filtered at the scan."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    if species and "meta_Species" in rows.columns:
        rows = rows.where(F.lower("meta_Species") == species.lower())
    return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows


def load_study(spark: SparkSession, root: str, study: str, keep: Filter | None = None, chain: str = "heavy", species: str | None = None, limit: int | None = None, max_shards: int | None = None) -> DataFrame:
    paths = study_files(spark, root, study, chain)
    rows = read_shards(spark, paths[:max_shards], species=species)
    kept = (keep or Filter()).apply(normalize(rows, {"Species": species or "", "Author": study}, study))
    return (kept.limit(limit) if limit else kept).dropDuplicates(["seq_id"])
