"""The sequence pool: normalisation, keyed append, consistency, libraries, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import germline as g
from ..functions.ids import content_id

REGION_COLUMNS = ("fwr1_aa", "cdr1_aa", "fwr2_aa", "cdr2_aa", "fwr3_aa", "cdr3_aa")
REQUIRED = ("sequence_alignment_aa", "cdr3_aa")
#: The columns that every pool row has.
INDEX_COLUMNS = ("seq_id", "source", "source_ref", "chain", "v_call", "v_gene", "v_family", "j_call", "j_gene", "cdr3_aa", "cdr3_len", "aa_seq", "redundancy", "n_ambiguous", "anarci_status", "has_liability", "species", "btype", "disease", "isotype")


def normalize(raw: DataFrame, meta: dict[str, str], source_ref: str) -> DataFrame:
    """Rearrangement rows in the pool's columns; columns it does not know stay.

    A missing column other than the required ones gives nulls. A null loop stays
    null, with a null length.
    """
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise KeyError(f"columns are missing: {missing}")
    has = raw.columns.__contains__
    column = lambda name: F.col(name) if has(name) else F.lit(None).cast("string")
    germline = F.coalesce(column("germline_alignment_aa"), column("v_germline_alignment_aa")) if has("germline_alignment_aa") else column("v_germline_alignment_aa")
    v_call, status = column("v_call"), column("ANARCI_status")
    aa = g.ungapped(F.col("sequence_alignment_aa"))
    new: dict[str, Column] = {
        "aa_gapped": F.col("sequence_alignment_aa"),
        "aa_seq": aa,
        "germline_aa": germline,
        **{c: column(c) for c in REGION_COLUMNS if not has(c)},
        "j_call": column("j_call"),
        "v_gene": g.gene(v_call),
        "v_family": g.family(v_call),
        "j_gene": g.gene(column("j_call")),
        "chain": g.chain_of(v_call),
        "cdr3_len": F.length("cdr3_aa"),
        "anarci_numbering": column("ANARCI_numbering"),
        "anarci_status": F.coalesce(status, F.lit("")),
        "has_liability": g.has_liability(status),
        "n_ambiguous": g.ambiguous_residues(aa),
        "redundancy": F.coalesce(column("Redundancy").cast("string").try_cast("int"), F.lit(1)),
        "isotype": F.coalesce(column("Isotype"), F.lit(meta.get("Isotype", ""))),
        "source": F.lit("OAS"),
        "source_ref": F.lit(source_ref),
        "species": F.lit(meta.get("Species", "")),
        "btype": F.lit(meta.get("BType", "")),
        "disease": F.lit(meta.get("Disease", "")),
        "study": F.lit(meta.get("Author") or meta.get("Study", "")),
        "seq_id": content_id("SEQ", F.lit(source_ref), aa),
    }
    return raw.withColumns(new)


def append_new(stored: DataFrame, fresh: DataFrame, key: str = "seq_id") -> DataFrame:
    """What an append adds: one row for each key that the store has not; stored rows win."""
    return fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def refreshed(stored: DataFrame, fresh: DataFrame, key: str = "seq_id") -> DataFrame:
    """The store with fresh rows in the place of stored ones of the same key."""
    one = fresh.dropDuplicates([key])
    return one.unionByName(stored.join(one.select(key), key, "left_anti"), allowMissingColumns=True)


def fetch(pool: DataFrame, ids: DataFrame, key: str = "seq_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each wanted id."""
    found = pool.join(ids.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    return found.select(*columns) if columns else found


def consistency(index: DataFrame, heap: DataFrame, key: str = "seq_id") -> DataFrame:
    """One row: ids of both sides, how many only one has, whether they agree."""
    sides = index.select(key, F.lit(1).alias("i"), F.lit(0).alias("h")).unionByName(heap.select(key, F.lit(0).alias("i"), F.lit(1).alias("h")))
    ids = sides.groupBy(key).agg(F.max("i").alias("i"), F.max("h").alias("h"))
    counts = ids.agg(*[F.count_if(e).cast("long").alias(n) for n, e in (("n_index", F.col("i") == 1), ("n_heap", F.col("h") == 1), ("only_index", F.col("h") == 0), ("only_heap", F.col("i") == 0))])
    return counts.withColumn("consistent", (F.col("only_index") == 0) & (F.col("only_heap") == 0))


def repaired(heap: DataFrame, index: DataFrame, key: str = "seq_id") -> DataFrame:
    """The heap without rows that the index has not, one of each key."""
    return heap.join(index.select(key), key, "left_semi").dropDuplicates([key])


def schema_drift(frame: DataFrame, expected: tuple[str, ...] = INDEX_COLUMNS) -> list[str]:
    """Expected columns that a frame has not."""
    return [c for c in expected if c not in frame.columns]


def make_library(ids: DataFrame, lib_id: str, order: list[Column], key: str = "seq_id") -> DataFrame:
    """(lib_id, seq_id, rank): a list frozen in order, ranks from 0. A library is a few hundred picks, so one window ranks it."""
    rank = F.row_number().over(W.Window.partitionBy(F.lit(lib_id)).orderBy(*order)) - 1
    return ids.select(F.lit(lib_id).alias("lib_id"), key, rank.cast("long").alias("rank"))


def library_members(members: DataFrame, sequences: DataFrame, lib_id: str) -> DataFrame:
    return members.where(F.col("lib_id") == lib_id).join(sequences, "seq_id")


def stats(pool: DataFrame) -> DataFrame:
    """(measure, name, value): total, rows by gene and by source, least, median and greatest CDR3 length."""
    whole = pool.agg(F.count("*").cast("double").alias("total"), F.min("cdr3_len").cast("double").alias("min"), F.median("cdr3_len").alias("median"), F.max("cdr3_len").cast("double").alias("max"))
    lines = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(n).alias("name"), F.col(c).alias("value")) for m, n, c in (("total", "rows", "total"), ("cdr3_len", "min", "min"), ("cdr3_len", "median", "median"), ("cdr3_len", "max", "max"))])
    by = [pool.groupBy(F.coalesce(F.col(c), F.lit("")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(m).alias("measure"), "name", "value") for m, c in (("gene", "v_gene"), ("source", "source_ref"))]
    return whole.select(F.inline(lines)).unionByName(by[0]).unionByName(by[1])


def flag_counts(rows: DataFrame, status: str = "anarci_status") -> DataFrame:
    """(flag, n) over all rows."""
    return rows.select(F.explode(g.status_flags(F.col(status))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def alignment_report(rows: DataFrame) -> DataFrame:
    """Per gene: rows, rows with numbering, whether a column view is possible, distinct, least and greatest gapped lengths."""
    length = F.length("aa_gapped")
    out = rows.groupBy("v_gene").agg(F.count("*").alias("n"), F.count("anarci_numbering").alias("with_numbering"), F.count_distinct(length).alias("n_lengths"), F.min(length).cast("long").alias("min_length"), F.max(length).cast("long").alias("max_length"))
    return out.withColumn("can_align", F.col("with_numbering") >= 2)


def pool_summary(rows: DataFrame) -> DataFrame:
    """Per gene: rows, mean CDR3 length, redundant reads."""
    return rows.groupBy("v_gene").agg(F.count("*").alias("n"), F.round(F.avg("cdr3_len"), 6).alias("mean_cdr3_len"), F.sum("redundancy").cast("long").alias("reads"))


def gene_composition(pool: DataFrame, picked: DataFrame, targets: DataFrame) -> DataFrame:
    """Per panel gene: its share of the pool, of the picks, and the share that was aimed at."""
    share = lambda f, n: f.groupBy("v_gene").agg(F.count("*").alias("k")).select("v_gene", (F.col("k") / F.sum("k").over(W.Window.partitionBy())).alias(n))  # noqa: E731  one row a gene
    out = targets.join(share(pool, "pool_share"), "v_gene", "left").join(share(picked, "pick_share"), "v_gene", "left")
    return out.na.fill(0.0, ["pool_share", "pick_share"])


def extract_meta(rows: DataFrame, prefix: str = "meta_") -> DataFrame:
    """(field, value) of the columns with a prefix: the one value, or how many there are; columns without a value are left out."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    if not names:
        return rows.sparkSession.createDataFrame([], "field string, value string")
    sums = [x for c in names for x in (F.count_distinct(F.col(c)).alias(f"n_{c}"), F.min(F.col(c).cast("string")).alias(f"v_{c}"))]
    lines = F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("field"), F.when(F.col(f"n_{c}") > 1, F.format_string("<%d values>", F.col(f"n_{c}"))).otherwise(F.col(f"v_{c}")).alias("value")) for c in names])
    return rows.agg(*sums).select(F.inline(lines)).where("value IS NOT NULL")


def cdr3_lengths(pool: DataFrame, picked: DataFrame) -> DataFrame:
    """(v_gene, cdr3_len, pool, picked): how many rows of each length either side has."""
    count = lambda f, n: f.groupBy("v_gene", "cdr3_len").agg(F.count("*").alias(n))
    return count(pool, "pool").join(count(picked, "picked"), ["v_gene", "cdr3_len"], "left").na.fill(0, ["picked"])


def family_distribution(pool: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent genes with their families."""
    return pool.groupBy("v_gene", "v_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v_gene").limit(top)
