"""References of alignments: germline tables, resolution by source, numbers, regions, columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import imgt
from ..functions.imgt import ANCHORS
from ..kernels import gotoh
from ..sources.fasta import read_germlines, resolve
from .alignment import consensus_germline, modal, numbered_long
from .spread import broadcast_within

# ---------------------------------------------------------------- tables


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(kind, chain, species, allele, gapped) of numbered germlines, gapped to 128 positions; Parquet, or CSV with a header."""
    rows = spark.read.option("header", "true").csv(path) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return rows.select("kind", "chain", "species", "allele", "gapped")


def lookup(table: DataFrame, genes: DataFrame, species: str = "human") -> DataFrame:
    """(gene, allele, sequence, numbers): the lowest allele of each gene and the position of each of its residues."""
    named = table.where(F.col("species") == species).withColumn("gene", F.substring_index("allele", "*", 1))
    own = named.join(genes.select("gene").distinct(), "gene")
    # the third letter of a gene tells its chain, the fourth whether it is a J
    kind = F.when(F.substring("gene", 4, 1) == "J", "J").otherwise("V")
    chain = F.when(F.substring("gene", 3, 1).isin("H", "K", "L"), F.substring("gene", 3, 1)).otherwise("H")
    best = own.where((F.col("kind") == kind) & (F.col("chain") == chain)).groupBy("gene").agg(F.min_by(F.struct("allele", "gapped"), "allele").alias("r"))
    letters = F.filter(F.transform(F.split("r.gapped", ""), lambda a, i: F.struct(a.alias("a"), (i + 1).alias("n"))), lambda x: ~x["a"].isin("-", ".", ""))
    return best.select("gene", "r.allele", F.array_join(F.transform(letters, lambda x: x["a"]), "").alias("sequence"), F.transform(letters, lambda x: x["n"]).alias("numbers"))


def known_genes(table: DataFrame, kind: str = "V", chain: str = "H", species: str = "human") -> DataFrame:
    """(gene) of a kind, chain and species."""
    own = table.where((F.col("kind") == kind) & (F.col("chain") == chain) & (F.col("species") == species))
    return own.select(F.substring_index("allele", "*", 1).alias("gene")).distinct()


def download(url: str, folder: str | Path, opener: Callable = urlopen, timeout: float = 60.0) -> Path:
    """Fetch a file once and keep it; a file that is there is not fetched again."""
    path = Path(folder) / (url.rstrip("/").rsplit("/", 1)[-1] or "germlines.fasta")
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        with opener(Request(url), timeout=timeout) as answer:
            content = answer.read()
        part = path.with_suffix(".part")
        part.write_bytes(content)
        part.replace(path)
    return path


def from_url(spark: SparkSession, genes: DataFrame, url: str, folder: str | Path, opener: Callable = urlopen) -> DataFrame:
    """(gene, allele, sequence) of genes in a FASTA file that is fetched to ``folder``."""
    return read_germlines(spark, str(download(url, folder, opener))).join(genes.select("gene").distinct(), "gene").select("gene", "allele", "sequence")


def coverage_report(genes: DataFrame, sources: list[tuple[str, DataFrame]], derived: tuple[str, ...] = ("pool",)) -> DataFrame:
    """(gene, resolved, source, length, derived): what each gene comes from before a batch relies on it."""
    found = resolve(genes, sources)
    return found.select("gene", F.col("sequence").isNotNull().alias("resolved"), "source", F.coalesce(F.length("sequence"), F.lit(0)).alias("length"), F.when(F.col("source").isNotNull(), F.col("source").isin(*derived)).alias("derived"))


# ---------------------------------------------------------------- germline by column


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq_id, position, residue) of (seq_id, positions, residues, same) rows that are the same and have as many of both."""
    for batch in batches:
        n, held = (pc.fill_null(pc.list_value_length(batch.column(i)), -1) for i in (1, 2))
        kept = batch.filter(pc.and_(pc.fill_null(batch.column(3), False), pc.and_(pc.equal(n, held), pc.greater(n, 0))))
        ids = kept.column(0).take(pc.list_parent_indices(kept.column(1)))
        yield pa.RecordBatch.from_arrays([ids, pc.list_flatten(kept.column(1)), pc.list_flatten(kept.column(2))], names=["seq_id", "position", "residue"])


def germline_by_column(rows: DataFrame, numbering: str = "anarci_numbering", gapped: str = "aa_gapped", germline: str = "germline_aa") -> DataFrame:
    """(seq_id, position, residue) of each row's germline in numbered columns.

    Sequence and germline stand letter by letter; the numbering covers the
    sequence's residues in order. A row whose lengths or counts disagree gives
    nothing, as a shifted germline would make every position look changed.
    """
    maps = F.flatten(F.transform(F.map_values(imgt.parse_numbering(F.col(numbering))), lambda m: F.map_keys(m)))
    keys = F.transform(F.array_sort(F.transform(F.array_distinct(F.transform(maps, lambda p: F.trim(p))), lambda p: F.struct(imgt.position_key(p).alias("k"), p.alias("p")))), lambda x: x["p"])
    pairs = F.filter(F.zip_with(F.split(gapped, ""), F.split(germline, ""), lambda s, g: F.struct(s.alias("s"), g.alias("g"))), lambda x: ~x["s"].isin(".", "-", ""))
    each = rows.select("seq_id", keys.alias("_k"), F.transform(pairs, lambda x: x["g"]).alias("_g"), (F.length(gapped) == F.length(germline)).alias("_same"))
    # a filter over these lists would be moved below them, and make them and the sequences once more for each place that names them
    return each.mapInArrow(_agreeing, T.StructType([rows.schema["seq_id"], *T.StructType.fromDDL("position string, residue string")]))


def germline_row(rows: DataFrame, **columns: str) -> DataFrame:
    """(position, residue, votes): the germline residue that most rows have in each column; the least of equals."""
    return modal(germline_by_column(rows, **columns), ["position"], "residue")


def reference_row(rows: DataFrame, germline: str = "germline_aa", sequence: str = "aa_gapped") -> DataFrame:
    """(v_gene, reference, label): the germline that most rows of a gene carry, labelled with how many there are; without any, the residues most rows have in each place."""
    own = rows.where(F.trim(F.coalesce(germline, F.lit(""))) != "")
    best = modal(own, ["v_gene"], germline).join(own.groupBy("v_gene").agg(F.count_distinct(germline).alias("_n")), "v_gene")
    told = best.select("v_gene", F.col(germline).alias("reference"), F.when(F.col("_n") == 1, "germline").otherwise(F.format_string("germline (modal of %d)", "_n")).alias("label"))
    bare = rows.join(told.select("v_gene"), "v_gene", "left_anti").where(F.length(sequence) > 0)
    wide = bare.join(bare.groupBy("v_gene").agg(F.max(F.length(sequence)).alias("_w")), "v_gene")
    letters = wide.select("v_gene", F.posexplode(F.split(F.rpad(sequence, F.col("_w"), F.lit(".")), "")).alias("place", "letter")).where("letter <> ''")
    seen = modal(letters, ["v_gene", "place"], "letter").groupBy("v_gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("reference"))
    return told.unionByName(seen.withColumn("label", F.lit("consensus (no germline column)")))


# ---------------------------------------------------------------- references of genes


def drop_loop(sequence: str, numbers: list[int | None]) -> tuple[str, list[int | None]]:
    """Without the residues of CDR3, so that one seam is left between the anchors."""
    kept = [(a, n) for a, n in zip(sequence, numbers, strict=True) if n is None or not ANCHORS[0] < n < ANCHORS[1]]
    return "".join(a for a, _ in kept), [n for _, n in kept]


def regions_of(numbers: list[int | None]) -> list[tuple[str, int, int]]:
    """(region, first index, last index + 1) of the stretches of a numbered reference."""
    names = [gotoh.region(n) for n in numbers]
    cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    return [(names[a], a, b) for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True) if names[a] is not None]


def column_regions(columns: list[int | None], numbers: list[int | None]) -> list[str | None]:
    """The region of every column: a residue's own; an inserted column's is that of the position after the residue before it, or of the first residue."""
    out: list[str | None] = []
    last = None  # index of the residue before
    for c in columns:
        if c is not None:
            last = c - 1
            out.append(gotoh.region(numbers[last]))
        elif last is None:
            out.append(gotoh.region(numbers[0]) if numbers else None)
        else:
            out.append(gotoh.region(numbers[last] + 1) if numbers[last] is not None else None)
    return out


def region_columns(columns: list[int | None], numbers: list[int | None]) -> list[tuple[str, int, int]]:
    """(region, first column, last column + 1), in order."""
    names = column_regions(columns, numbers)
    cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    return [(names[a], a, b) for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True) if names[a] is not None]


def modal_j(rows: DataFrame) -> DataFrame:
    """(v_gene, j_gene): the J gene that most rows of a V gene call."""
    return modal(rows.where(F.trim("j_gene") != ""), ["v_gene"], "j_gene").select("v_gene", "j_gene")


def references_for(rows: DataFrame, table: DataFrame | None = None, fasta: DataFrame | None = None, germline: str = "germline_aa", min_support: int = 1) -> DataFrame:
    """(v_gene, germline_aa, numbers, label): what each gene of ``rows`` is aligned with, by the first source that has it.

    A FASTA record (gene, allele, sequence) comes before the table's lowest
    allele; either is followed by the modal J gene of the table, as a V gene ends
    at the second anchor's loop, and residues of CDR3 are dropped. Failing both,
    the majority of each column over the germlines of the rows, which has no numbers and says so.
    """
    genes = rows.where("v_gene IS NOT NULL").select(F.col("v_gene").alias("gene")).distinct()
    spark = rows.sparkSession
    numbered = "gene string, allele string, sequence string, numbers array<int>"
    v = lookup(table, genes) if table is not None else spark.createDataFrame([], numbered)
    if fasta is not None:
        own = fasta.join(genes, "gene").select("gene", "allele", "sequence", F.lit(None).cast("array<int>").alias("numbers"))
        v = own.unionByName(v.join(own.select("gene"), "gene", "left_anti"))
    j = modal_j(rows) if table is not None and "j_gene" in rows.columns else None
    if j is not None:
        tails = lookup(table, j.select(F.col("j_gene").alias("gene"))).select(F.col("gene").alias("j_gene"), F.col("allele").alias("j_allele"), F.col("sequence").alias("j_sequence"), F.col("numbers").alias("j_numbers"))
        v = v.join(j.withColumnRenamed("v_gene", "gene"), "gene", "left").join(tails, "j_gene", "left")
    else:
        v = v.withColumns({"j_allele": F.lit(None).cast("string"), "j_sequence": F.lit(None).cast("string"), "j_numbers": F.lit(None).cast("array<int>")})
    none = lambda s: F.transform(F.split(s, ""), lambda _: F.lit(None).cast("int"))
    numbers = F.concat(F.coalesce("numbers", none("sequence")), F.coalesce("j_numbers", F.array().cast("array<int>")))
    letters = F.split(F.concat("sequence", F.coalesce("j_sequence", F.lit(""))), "")
    kept = F.filter(F.zip_with(letters, numbers, lambda a, n: F.struct(a.alias("a"), n.alias("n"))), lambda x: x["n"].isNull() | ~x["n"].between(ANCHORS[0] + 1, ANCHORS[1] - 1))
    label = F.concat(F.lit("IMGT "), F.coalesce("allele", "gene"), F.coalesce(F.concat(F.lit(" + "), F.col("j_allele")), F.lit("")))
    known = v.select(F.col("gene").alias("v_gene"), F.array_join(F.transform(kept, lambda x: x["a"]), "").alias("germline_aa"), F.transform(kept, lambda x: x["n"]).alias("numbers"), label.alias("label"))
    seen = consensus_germline(rows.join(known.select("v_gene"), "v_gene", "left_anti"), min_support, germline)
    return known.unionByName(seen.select("v_gene", "germline_aa", F.lit(None).cast("array<int>").alias("numbers"), F.format_string("germline consensus (n=%d)", "votes").alias("label")))


_MSA = "v_gene string, seq_id string, gapped string, reference string, identity double, n_columns int, columns array<int>, label string"


def build_msa(rows: DataFrame, references: DataFrame, backend: str = "reference") -> DataFrame:
    """(v_gene, seq_id, gapped, reference, identity, n_columns, columns, label): the rows that an alignment shows, in one column space for each gene.

    ``rows`` are a few dozen of each gene (``alignment.rows_to_align``).
    ``columns`` has the residue number of each column, null where inserted.
    Identity counts the reference's columns; a gap is no match.
    """
    aligner = gotoh.BACKENDS.get(backend)
    joined = rows.select("v_gene", "seq_id", "aa_seq").join(broadcast_within(references.select("v_gene", "germline_aa", "numbers", "label"), "germline_aa"), "v_gene")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("seq_id").sort_values("seq_id", ignore_index=True)
        numbers = group.numbers[0]
        numbers = None if numbers is None or all(pd.isna(n) for n in numbers) else [None if pd.isna(n) else int(n) for n in numbers]
        top, laid, columns = aligner(group.germline_aa[0], [s.replace("-", "").replace(".", "") for s in group.aa_seq], numbers)
        held = [i for i, c in enumerate(columns) if c is not None]
        same = [sum(row[i] == top[i] for i in held) / max(1, len(held)) for row in laid]
        return pd.DataFrame({"v_gene": group.v_gene, "seq_id": group.seq_id, "gapped": laid, "reference": top, "identity": same, "n_columns": len(top), "columns": [columns] * len(laid), "label": group.label})

    return joined.groupBy("v_gene").applyInPandas(build, _MSA)


def region_spans(gapped: Column, regions: dict[str, Column]) -> Column:
    """array of struct(region, first, last) column ranges (from 0, end exclusive) of a gapped sequence.

    Each region's residues are searched for after the one before, or anywhere if
    they are not there; a region that is nowhere is left out.
    """
    letters = F.filter(F.transform(F.split(gapped, ""), lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: ~x["a"].isin(".", "-", ""))
    plain = F.array_join(F.transform(letters, lambda x: x["a"]), "")
    state = "struct<at:int,spans:array<struct<region:string,first:int,last:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<region:string,first:int,last:int>>").alias("spans")).cast(state)
    parts = F.array(*[F.struct(F.lit(n).alias("region"), F.coalesce(c, F.lit("")).alias("s")) for n, c in regions.items()])

    def step(s: Column, x: Column) -> Column:
        later = F.locate_column(x["s"], plain, s["at"] + 1) if hasattr(F, "locate_column") else F.call_function("locate", x["s"], plain, s["at"] + 1)
        found = F.when(later > 0, later).otherwise(F.call_function("locate", x["s"], plain))
        end = found + F.length(x["s"]) - 1
        span = F.struct(x["region"].alias("region"), F.get(letters, found - 1)["i"].alias("first"), (F.get(letters, end - 1)["i"] + 1).alias("last"))
        use = (F.trim(x["s"]) != "") & (found > 0)
        return F.when(use, F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans")).cast(state)).otherwise(s)

    return F.aggregate(parts, zero, step, lambda s: s["spans"])


def available_backends() -> list[str]:
    return list(gotoh.BACKENDS)
