"""Germline FASTA with bar-separated headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_germlines(spark: SparkSession, path: str) -> DataFrame:
    """(gene, allele, accession, species, sequence): the first allele of each gene by name, gaps taken out."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    parts = F.split(F.element_at(F.split("value", "\n"), 1), r"\|")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"[\s.]", "")
    rows = records.select(F.get(parts, 0).alias("accession"), F.get(parts, 1).alias("call"), F.get(parts, 2).alias("species"), F.upper(body).alias("sequence")).where("call IS NOT NULL")
    named = rows.select(F.substring_index("call", "*", 1).alias("gene"), F.coalesce(F.nullif(F.substring_index("call", "*", -1), F.substring_index("call", "*", 1)), F.lit("")).alias("allele"), "accession", "species", "sequence")
    return named.groupBy("gene").agg(F.min_by(F.struct("allele", "accession", "species", "sequence"), F.struct("allele", "accession")).alias("r")).select("gene", "r.*")


def resolve(genes: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(gene, sequence, source): of sources (gene, sequence) in order the first that has the gene; nulls if none has."""
    out, found = genes.select("gene").distinct(), []
    for i, (_, frame) in enumerate(sources):
        out = out.join(frame.select("gene", F.col("sequence").alias(f"_{i}")).dropDuplicates(["gene"]), "gene", "left")
        found.append(F.col(f"_{i}"))
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, (n, _) in zip(found, sources, strict=True)])
    return out.select("gene", F.coalesce(*found).alias("sequence"), label.alias("source"))
