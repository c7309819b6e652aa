"""Scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, ids, imgt, wells
from ..functions import germline as g
from . import derive as d
from .catalog import query

_WELL_SQL = "concat(chr(CAST(65 + p % 8 AS INT)), lpad(CAST(1 + p // 8 AS VARCHAR), 2, '0'))"


@query(f"""
    SELECT doc_id, CAST(len(string_split(v_call, ',')) AS BIGINT) AS n_calls, split_part(v_call, ',', 1) AS top_call, split_part(split_part(v_call, ',', 1), '*', 1) AS gene,
           regexp_extract(v_call, '^(IG[HKL][VDJ][0-9]+)', 1) AS family, split_part(split_part(v_call, ',', 1), '*', 2) AS allele, CASE WHEN substr(v_call, 3, 1) = 'H' THEN 'H' ELSE 'L' END AS chain
    FROM ({d.REPERTOIRE_SQL})
""")
def germline_calls(spark, sf):
    c = F.col("v_call")
    return d.repertoire(spark, sf).select("doc_id", F.size(g.split_calls(c)).cast("long").alias("n_calls"), g.top_call(c).alias("top_call"), g.gene(c).alias("gene"), g.family(c).alias("family"), g.allele(c).alias("allele"), g.chain_of(c).alias("chain"))


@query(f"""
    SELECT a.doc_id AS a, b.doc_id AS b, CAST(levenshtein(a.cdr3_aa, b.cdr3_aa) AS BIGINT) AS edits,
           round(CASE WHEN greatest(length(a.cdr3_aa), length(b.cdr3_aa)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.cdr3_aa, b.cdr3_aa) / greatest(length(a.cdr3_aa), length(b.cdr3_aa)) END, 9) AS identity
    FROM ({d.REPERTOIRE_SQL}) a JOIN ({d.REPERTOIRE_SQL}) b ON a.doc_id + 6 = b.doc_id
""")
def cdr3_identity_pairs(spark, sf):
    """Each loop with the next one of its gene."""
    r = d.repertoire(spark, sf).select("doc_id", "cdr3_aa")
    a, b = r.select((F.col("doc_id") + 6).alias("b"), F.col("doc_id").alias("a"), F.col("cdr3_aa").alias("x")), r.select(F.col("doc_id").alias("b"), F.col("cdr3_aa").alias("y"))
    return a.join(b, "b").select("a", "b", F.levenshtein("x", "y").cast("long").alias("edits"), F.round(g.identity(F.col("x"), F.col("y")), 9).alias("identity"))


_RAW = "CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN lower({w}) WHEN 1 THEN concat(' ', substr({w}, 1, 1), ' ', substr({w}, 2), ' ') WHEN 2 THEN concat(substr({w}, 2), substr({w}, 1, 1)) ELSE concat('Z', substr({w}, 2)) END"


@query(f"""
    SELECT raw, well, count(*) AS n FROM (
        SELECT {_RAW.format(w="w")} AS raw, CASE WHEN l_linenumber % 4 < 3 THEN w END AS well
        FROM (SELECT l_linenumber, {_WELL_SQL} AS w FROM (SELECT l_linenumber, l_partkey % 96 AS p FROM lineitem))) GROUP BY ALL
""")
def well_normalize(spark, sf):
    rows = d.transfers(spark, sf).withColumn("w", F.col("source_well"))
    return rows.select(F.expr(_RAW.format(w="w")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).select("raw", wells.normalize(F.col("raw")).alias("well"), "n")


@query(f"""
    SELECT {_WELL_SQL} AS well, CAST(p % 8 + 1 AS BIGINT) AS "row", CAST(p // 8 + 1 AS BIGINT) AS col, CAST(p + 1 AS BIGINT) AS down, CAST((p % 8) * 12 + p // 8 + 1 AS BIGINT) AS along,
           p % 8 IN (0, 7) OR p // 8 IN (0, 11) AS edge, (SELECT count(*) FROM lineitem WHERE l_partkey % 96 = p) AS n
    FROM range(96) t(p)
""")
def well_ordinals(spark, sf):
    n = d.transfers(spark, sf).groupBy(F.col("source_well").alias("well")).agg(F.count("*").alias("n"))
    w = F.col("well")
    plate = wells.all_wells(spark).join(n, "well", "left")
    return plate.select("well", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), wells.column_major(w).cast("long").alias("down"), wells.row_major(w).cast("long").alias("along"), wells.is_edge(w).alias("edge"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"SELECT doc_id, round(CASE WHEN length(dna) = 0 THEN 0.0 ELSE length(regexp_replace(dna, '[^GC]', '', 'g')) / length(dna) END, 9) AS gc, CAST(length(dna) AS BIGINT) AS bp FROM (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents)")
def gc_content(spark, sf):
    x = F.col("dna")
    return d.texts(spark, sf).select("doc_id", d.bases().alias("dna")).select("doc_id", F.round(dna.gc_fraction(x), 9).alias("gc"), F.length(x).cast("long").alias("bp"))


@query(f"SELECT doc_id, md5(reverse(translate(dna, 'ACGT', 'TGCA'))) AS digest FROM (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents)")
def reverse_complement(spark, sf):
    return d.texts(spark, sf).select("doc_id", F.md5(dna.reverse_complement(d.bases())).alias("digest"))


@query(f"SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all({d.DNA_SQL}, '(A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}})')) AS run FROM documents) GROUP BY run")
def homopolymer_runs(spark, sf):
    return d.texts(spark, sf).select(F.explode(dna.homopolymers(d.bases(), 4)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


_CODES = ", ".join(f"'{c}': '{r}'" for c, r in dna.CODONS.items())


@query(f"""
    SELECT doc_id, md5(array_to_string(list_transform(range(0, CAST(length(dna) // 3 AS BIGINT)), lambda i: coalesce(element_at(m, substr(dna, CAST(3 * i + 1 AS BIGINT), 3))[1], 'X')), '')) AS digest
    FROM (SELECT doc_id, {d.DNA_SQL} AS dna, MAP {{{_CODES}}} AS m FROM documents)
""")
def codon_translate(spark, sf):
    return d.texts(spark, sf).select("doc_id", F.md5(dna.translate(d.bases())).alias("digest"))


@query(f"SELECT doc_id, coalesce(anarci_status, '') AS status, has_liability FROM ({d.POOL_SQL})")
def liability_flags(spark, sf):
    return d.pool(spark, sf).select("doc_id", F.coalesce("anarci_status", F.lit("")).alias("status"), "has_liability")


@query(f"SELECT trim(f) AS flag, count(*) AS n FROM (SELECT unnest(string_split(coalesce(anarci_status, ''), '|')) AS f FROM ({d.REPERTOIRE_SQL})) WHERE trim(f) <> '' GROUP BY 1")
def flag_counts(spark, sf):
    from ..operators.pool import flag_counts as op

    return op(d.repertoire(spark, sf))


@query(f"SELECT n_ambiguous, count(*) AS n FROM ({d.POOL_SQL}) GROUP BY 1")
def ambiguous_residues(spark, sf):
    return d.pool(spark, sf).groupBy("n_ambiguous").agg(F.count("*").alias("n"))


_AT = "floor(length(dna) / 2)"


@query(f"""
    SELECT doc_id, list_filter(['GGTCTC', 'GAGACC', 'CGTCTC', 'GAGACG', 'GAAGAC', 'GTCTTC'], lambda s: contains(dna, s)) AS sites FROM (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents)
""")
def restriction_sites(spark, sf):
    return d.texts(spark, sf).select("doc_id", dna.internal_sites(d.bases(), ["BsaI", "BsmBI", "BbsI"]).alias("sites"))


@query(f"""
    SELECT doc_id, substr(concat(dna, dna), CAST(length(dna) - 5 + 1 AS BIGINT), CAST(5 + 7 AS BIGINT)) AS over_origin FROM (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents) WHERE length(dna) >= 20
""")
def circular_slices(spark, sf):
    rows = d.texts(spark, sf).select("doc_id", d.bases().alias("dna")).where(F.length("dna") >= 20)
    return rows.select("doc_id", dna.circular_slice(F.col("dna"), F.length("dna") - 5, F.lit(7)).alias("over_origin"))


@query("""
    SELECT n AS number, CASE WHEN n BETWEEN 1 AND 26 THEN 'FR1' WHEN n <= 38 THEN 'CDR1' WHEN n <= 55 THEN 'FR2' WHEN n <= 65 THEN 'CDR2' WHEN n <= 104 THEN 'FR3' WHEN n <= 117 THEN 'CDR3' ELSE 'FR4' END AS region,
           count(*) AS n_lines FROM (SELECT 1 + l_partkey % 128 AS n FROM lineitem) GROUP BY 1, 2
""")
def imgt_regions(spark, sf):
    n = d.table(spark, sf, "lineitem").select((1 + F.col("l_partkey") % 128).alias("number")).groupBy("number").agg(F.count("*").alias("n_lines"))
    return n.select("number", imgt.region_of(F.col("number")).alias("region"), "n_lines")


@query("""
    SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'PLT' WHEN 1 THEN 'SEQ' END AS prefix, o_orderkey % 4 = 0 AS is_plate,
           concat('SEQ-', substr(sha256(concat(o_orderstatus, '|', o_orderkey)), 1, 12)) AS content_id FROM orders
""")
def typed_ids(spark, sf):
    rows = d.table(spark, sf, "orders").withColumn("id", F.expr("CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN concat('PLT-', o_orderkey) WHEN 1 THEN concat('SEQ-', o_orderkey) WHEN 2 THEN concat('NOPE-', o_orderkey) ELSE 'plain' END"))
    return rows.select("o_orderkey", ids.prefix_of(F.col("id")).alias("prefix"), ids.is_a(F.col("id"), "PLT").alias("is_plate"), ids.content_id("SEQ", F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("content_id"))
