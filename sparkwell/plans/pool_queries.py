"""Pool, filters, libraries, selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import pool as op
from ..operators import selection, similar, store
from ..operators.filters import Filter
from ..operators.storage import LOCAL
from ..sinks.units import write_units
from ..sources import formats
from . import derive as d
from .catalog import query

#: The filter that the selection queries use.
KEEP = Filter(genes=("IGHV3-23", "IGHV1-69", "IGHV3-53", "IGHV4-34"), chain="H", cdr3_len_range=(10, 28), min_redundancy=1)
_PRODUCTIVE = "(productive IS NULL OR upper(trim(productive)) IN ('NAN', 'NONE', '', 'T', 'TRUE', 'YES', '1'))"
_STEPS = (
    ("productive", _PRODUCTIVE),
    ("chain == H", "chain = 'H'"),
    ("v_gene in 4 panel genes", "v_gene IN ('IGHV3-23', 'IGHV1-69', 'IGHV3-53', 'IGHV4-34')"),
    ("cdr3_len 10-28", "cdr3_len BETWEEN 10 AND 28"),
    ("redundancy >= 1", "coalesce(redundancy, 1) >= 1"),
    ("no liability", "NOT has_liability"),
    ("ambiguous residues <= 0", "n_ambiguous <= 0"),
)
_KEPT = " AND ".join(p for _, p in _STEPS)
_KEPT_SQL = f"SELECT * FROM ({d.POOL_SQL}) WHERE {_KEPT}"


def _kept(spark, sf):
    return KEEP.apply(d.pool(spark, sf))


@query(f"SELECT v_gene, count(*) AS n, round(avg(cdr3_len), 6) AS mean_cdr3_len, min(cdr3_len) AS min_cdr3_len, max(cdr3_len) AS max_cdr3_len FROM ({_KEPT_SQL}) GROUP BY 1")
def pool_filter_by_gene(spark, sf):
    """Scan, normalise, filter, group."""
    return _kept(spark, sf).groupBy("v_gene").agg(F.count("*").alias("n"), F.round(F.avg("cdr3_len"), 6).alias("mean_cdr3_len"), F.min("cdr3_len").alias("min_cdr3_len"), F.max("cdr3_len").alias("max_cdr3_len"))


def _funnel_sql() -> str:
    parts, passed = ["SELECT 0 AS place, 'input' AS step, count(*) AS rows FROM p"], []
    for i, (name, predicate) in enumerate(_STEPS, 1):
        passed.append(predicate)
        parts.append(f"SELECT {i}, '{name}', count(*) FROM p WHERE {' AND '.join(passed)}")
    parts.append(f"SELECT {len(_STEPS) + 1}, 'unique cdr3', count(DISTINCT cdr3_aa) FROM p WHERE {_KEPT}")
    return f"WITH p AS ({d.POOL_SQL}), f AS ({' UNION ALL '.join(parts)}) SELECT place, step, rows, coalesce(lag(rows) OVER (ORDER BY place) - rows, 0) AS dropped FROM f"


@query(_funnel_sql())
def filter_funnel(spark, sf):
    from dataclasses import replace

    return replace(KEEP, drop_duplicate_cdr3=True).explain(d.pool(spark, sf))


@query(f"SELECT cdr3_aa, min(seq_id) AS seq_id FROM ({_KEPT_SQL}) GROUP BY 1")
def unique_cdr3(spark, sf):
    from dataclasses import replace

    return replace(KEEP, drop_duplicate_cdr3=True).apply(d.pool(spark, sf)).select("cdr3_aa", "seq_id")


@query(f"""
    WITH p AS ({d.POOL_SQL})
    SELECT 'total' AS measure, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM p
    UNION ALL SELECT 'cdr3_len', 'min', CAST(min(cdr3_len) AS DOUBLE) FROM p
    UNION ALL SELECT 'cdr3_len', 'median', median(cdr3_len) FROM p
    UNION ALL SELECT 'cdr3_len', 'max', CAST(max(cdr3_len) AS DOUBLE) FROM p
    UNION ALL SELECT 'gene', v_gene, CAST(count(*) AS DOUBLE) FROM p GROUP BY v_gene
    UNION ALL SELECT 'source', source_ref, CAST(count(*) AS DOUBLE) FROM p GROUP BY source_ref
""")
def pool_stats(spark, sf):
    return op.stats(d.pool(spark, sf))


@query(f"SELECT v_gene, count(*) AS n, round(avg(cdr3_len), 6) AS mean_cdr3_len, CAST(sum(redundancy) AS BIGINT) AS reads FROM ({d.POOL_SQL}) GROUP BY 1")
def pool_summary(spark, sf):
    return op.pool_summary(d.pool(spark, sf))


_GAPPED = "concat(substr(aa_seq, 1, CAST(20 + doc_id % 7 AS INT)), '--', substr(aa_seq, 30, 10))"


@query(f"""
    SELECT v_gene, count(*) AS n, count(anarci_status) AS with_numbering, count(DISTINCT length({_GAPPED})) AS n_lengths, CAST(min(length({_GAPPED})) AS BIGINT) AS min_length,
           CAST(max(length({_GAPPED})) AS BIGINT) AS max_length, count(anarci_status) >= 2 AS can_align FROM ({d.POOL_SQL}) GROUP BY 1
""")
def alignment_report(spark, sf):
    return op.alignment_report(d.pool(spark, sf).withColumns({"aa_gapped": F.expr(_GAPPED), "anarci_numbering": F.col("anarci_status")}))


@query("SELECT l_partkey % 500 AS id, min(l_quantity) AS quantity FROM lineitem WHERE l_partkey % 500 NOT IN (SELECT s_suppkey % 500 FROM supplier) GROUP BY 1")
def ingest_anti_join(spark, sf):
    """Rows of a delivery whose key the store has not."""
    fresh = d.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 500).alias("id")).agg(F.min("l_quantity").alias("quantity"))
    return op.append_new(d.table(spark, sf, "supplier").select((F.col("s_suppkey") % 500).alias("id")), fresh, "id")


@query("""
    WITH old AS (SELECT c_custkey AS id, c_acctbal AS balance FROM customer), new AS (SELECT o_custkey AS id, max(o_totalprice) AS balance FROM orders GROUP BY 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)
""")
def ingest_refresh(spark, sf):
    """Fresh rows in the place of stored ones."""
    old = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return op.refreshed(old, d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance")), "id")


@query("""
    SELECT count(DISTINCT c) AS n_index, count(DISTINCT o) AS n_heap, count(*) FILTER (o IS NULL) AS only_index, count(*) FILTER (c IS NULL) AS only_heap,
           count(*) FILTER (o IS NULL) = 0 AND count(*) FILTER (c IS NULL) = 0 AS consistent
    FROM (SELECT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o
""")
def store_consistency(spark, sf):
    return op.consistency(d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), d.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pool_fetch(spark, sf):
    """Rows for a list of ids, one of each."""
    wanted = d.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = d.table(spark, sf, "orders").join(wanted, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return op.fetch(orders, orders.select("id"), "id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)")
def clustered_fetch(spark, sf):
    """Orders written in ranges of their key, of which a list of ids is read."""
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or LOCAL}/clustered-{uuid.uuid4().hex}"
    store.append_clustered(d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey")
    return store.fetch(spark, path, d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_orderkey")), "o_orderkey")


@query(f"SELECT row_number() OVER (ORDER BY cdr3_len DESC, seq_id) - 1 AS rank, seq_id, v_gene, cdr3_aa FROM ({_KEPT_SQL}) WHERE v_gene = 'IGHV3-53'")
def library_members(spark, sf):
    """A frozen list with its order, joined with its sequences."""
    picks = _kept(spark, sf).where("v_gene = 'IGHV3-53'")
    members = op.make_library(picks.select("seq_id", "cdr3_len"), "LIB-1", [F.desc("cdr3_len"), F.col("seq_id")])
    return op.library_members(members, d.pool(spark, sf), "LIB-1").select("rank", "seq_id", "v_gene", "cdr3_aa")


@query("""
    SELECT field, CASE WHEN n > 1 THEN concat('<', n, ' values>') ELSE v END AS value FROM (
        SELECT 'lang' AS field, count(DISTINCT lang) AS n, min(lang) AS v FROM documents UNION ALL SELECT 'source', count(DISTINCT source), min(source) FROM documents
        UNION ALL SELECT 'species', 1, 'human')
""")
def study_metadata(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("lang").alias("meta_lang"), F.col("source").alias("meta_source"), F.lit("human").alias("meta_species"), F.lit(None).cast("string").alias("meta_empty"))
    return op.extract_meta(docs)


@query("""
    WITH e AS (SELECT p_brand AS v_gene, 96 * count(*) / sum(count(*)) OVER () AS exact FROM part GROUP BY 1),
         r AS (SELECT v_gene, floor(round(exact, 9)) AS low, row_number() OVER (ORDER BY round(exact - floor(round(exact, 9)), 9) DESC, v_gene) AS place, 96 - sum(floor(round(exact, 9))) OVER () AS rest FROM e)
    SELECT v_gene, CAST(greatest(1, low + CASE WHEN place <= rest THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM r
""")
def panel_quotas(spark, sf):
    return selection.quotas(d.table(spark, sf, "part").groupBy(F.col("p_brand").alias("v_gene")).agg(F.count("*").cast("double").alias("fraction")), 96)


@query(f"""
    WITH k AS ({_KEPT_SQL}), e AS (SELECT v_gene, list_sort(list_distinct(quantile_cont(cdr3_len, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM k GROUP BY 1)
    SELECT seq_id, v_gene, cdr3_len, CAST(len(list_filter(edges[2:len(edges) - 1], lambda x: cdr3_len > x)) AS BIGINT) AS bin FROM k JOIN e USING (v_gene)
""")
def length_bins(spark, sf):
    return selection.length_bins(_kept(spark, sf).select("seq_id", "v_gene", "cdr3_len"))


#: A selection that SQL can state too: of each gene and loop length the row of the least digest.
_FIRST = f"SELECT seq_id, v_gene, cdr3_aa, cdr3_len FROM (SELECT *, row_number() OVER (PARTITION BY v_gene, cdr3_len ORDER BY md5(seq_id), seq_id) AS r FROM ({_KEPT_SQL})) WHERE r = 1"


def _picks(spark, sf):
    """One row of each gene and loop length, as many as a plate holds."""
    one = _kept(spark, sf).groupBy("v_gene", "cdr3_len").agg(F.min_by(F.struct("seq_id", "cdr3_aa"), F.struct(F.md5("seq_id"), "seq_id")).alias("r"))
    return one.select("r.seq_id", "v_gene", "r.cdr3_aa", "cdr3_len")


_PAIRS = f"""
    WITH p AS ({_FIRST}), q AS (SELECT x.seq_id AS a, y.seq_id AS b, round(1 - levenshtein(x.cdr3_aa, y.cdr3_aa) / greatest(length(x.cdr3_aa), length(y.cdr3_aa)), 9) AS identity FROM p x JOIN p y ON x.seq_id < y.seq_id)
"""


@query(f"{_PAIRS} SELECT * FROM q ORDER BY identity DESC, a, b LIMIT 1")
def worst_pair(spark, sf):
    return selection.worst_pair(_picks(spark, sf))


@query(f"""
    {_PAIRS}, g AS (SELECT v_gene, count(*) AS k FROM p GROUP BY 1)
    SELECT n, length_span, n_genes, min_gene, max_identity, max_identity <= 0.8 AND length_span >= 8 AND n_genes >= 1 AND min_gene >= 1 AS passed
    FROM (SELECT count(*) AS n, max(cdr3_len) - min(cdr3_len) AS length_span FROM p), (SELECT count(*) AS n_genes, min(k) AS min_gene FROM g), (SELECT max(identity) AS max_identity FROM q)
""")
def spec_check(spark, sf):
    return selection.Spec().check(_picks(spark, sf))


@query(f"""
    WITH p AS ({_FIRST}), n AS (SELECT count(*) AS n FROM p), i AS (SELECT unnest(range(1, 11)) AS draw),
    d AS (SELECT draw, seq_id, cdr3_aa, row_number() OVER (PARTITION BY draw ORDER BY md5(concat('42:', draw, ':', seq_id)), seq_id) AS r FROM ({_KEPT_SQL}), i),
    e AS (SELECT draw, seq_id, cdr3_aa FROM d, n WHERE r <= n UNION ALL SELECT 0, seq_id, cdr3_aa FROM p)
    SELECT CAST(x.draw AS INTEGER) AS draw, max(round(1 - levenshtein(x.cdr3_aa, y.cdr3_aa) / greatest(length(x.cdr3_aa), length(y.cdr3_aa)), 9)) AS identity FROM e x JOIN e y ON x.draw = y.draw AND x.seq_id < y.seq_id GROUP BY 1
""")
def identity_curve(spark, sf):
    """The worst identity among the picks, and among ten random sets of as many rows."""
    return similar.identity_curve(_kept(spark, sf), _picks(spark, sf), draws=10)


@query(f"""
    WITH l AS (SELECT DISTINCT v_gene, cdr3_aa FROM ({d.POOL_SQL}) WHERE cdr3_aa <> '')
    SELECT x.v_gene, x.cdr3_aa AS a, y.cdr3_aa AS b, CAST(levenshtein(x.cdr3_aa, y.cdr3_aa) AS INTEGER) AS distance FROM l x JOIN l y ON x.v_gene = y.v_gene AND x.cdr3_aa < y.cdr3_aa WHERE abs(length(x.cdr3_aa) - length(y.cdr3_aa)) <= 2 AND levenshtein(x.cdr3_aa, y.cdr3_aa) <= 2
""")
def loop_neighbours(spark, sf):
    """Distinct loops of a gene that are two edits apart at most."""
    loops = d.pool(spark, sf).where("cdr3_aa <> ''").select("v_gene", "cdr3_aa").distinct()
    return similar.within_edits(loops, 2, "cdr3_aa", "cdr3_aa", "v_gene").select("v_gene", "a", "b", "distance")


@query()
def diversity_sample(spark, sf):
    """96 picks by quota, length bin and greedy distance."""
    panel = selection.Panel("test", {"IGHV3-23": 0.5, "IGHV1-69": 0.3, "IGHV3-53": 0.2})
    return selection.sample(_kept(spark, sf), 96, panel)


@query()
def plate_grouping(spark, sf):
    return selection.group_for_plate(_picks(spark, sf)).select("seq_id", "v_gene", "cdr3_aa", "place")


@query(f"""
    WITH p AS (SELECT v_gene, count(*) / sum(count(*)) OVER () AS s FROM ({_KEPT_SQL}) GROUP BY 1), k AS (SELECT v_gene, count(*) / sum(count(*)) OVER () AS s FROM ({_FIRST}) GROUP BY 1)
    SELECT t.v_gene, t.fraction, coalesce(p.s, 0) AS pool_share, coalesce(k.s, 0) AS pick_share
    FROM (VALUES ('IGHV3-23', 0.60::DOUBLE), ('IGHV1-69', 0.25::DOUBLE), ('IGHV3-53', 0.15::DOUBLE)) t(v_gene, fraction) LEFT JOIN p USING (v_gene) LEFT JOIN k USING (v_gene)
""")
def gene_composition(spark, sf):
    return op.gene_composition(_kept(spark, sf), _picks(spark, sf), selection.PANELS["default-v1"].frame(spark))


@query(f"WITH k AS (SELECT v_gene, cdr3_len, count(*) AS picked FROM ({_FIRST}) GROUP BY 1, 2) SELECT v_gene, cdr3_len, count(*) AS pool, coalesce(any_value(picked), 0) AS picked FROM ({_KEPT_SQL}) LEFT JOIN k USING (v_gene, cdr3_len) GROUP BY 1, 2")
def cdr3_lengths(spark, sf):
    return op.cdr3_lengths(_kept(spark, sf), _picks(spark, sf))


@query(f"SELECT v_gene, v_family, count(*) AS n FROM ({d.POOL_SQL}) GROUP BY 1, 2 ORDER BY n DESC, v_gene LIMIT 15")
def family_distribution(spark, sf):
    return op.family_distribution(d.pool(spark, sf))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS added, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def evolved_schema(spark, sf):
    """A declared column that the stored table has not is null; one that is not declared stays."""
    from pyspark.sql import types as T

    from ..operators import store

    rows = store.read(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderstatus", "o_custkey"], o_orderstatus="F")
    named = rows.withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status"})
    return store.evolve(named, T.StructType.fromDDL("id long, status string, added double"))


@query(f"""
    SELECT v_call, j_call, nullif(anarci_status, '') AS anarci_status, nullif(productive, '') AS productive, 'human' AS species, count(*) AS n, CAST(sum(length(aa_seq)) AS BIGINT) AS residues, CAST(sum(redundancy) AS BIGINT) AS reads, min(doc_id) AS first_id, max(sha256(concat(doc_id, ' ', aa_seq, ' ', cdr3_aa))) AS last_digest
    FROM ({d.REPERTOIRE_SQL}) GROUP BY 1, 2, 3, 4
""")
def unit_format(spark, sf):
    """The repertoire written as units, a task each, and read again by the format; columns are chosen by a schema."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or LOCAL}/units-{uuid.uuid4().hex}"
    write_units(d.repertoire(spark, sf), folder, {"Species": "human"})
    formats.register(spark)
    wanted = "doc_id string, v_call string, j_call string, aa_seq string, cdr3_aa string, anarci_status string, productive string, redundancy string, _meta map<string,string>"
    rows = spark.read.format("repertoire_unit").schema(wanted).option("mode", "FAILFAST").load(folder)
    text = F.concat_ws(" ", "doc_id", F.coalesce("aa_seq", F.lit("")), F.coalesce("cdr3_aa", F.lit("")))
    totals = (F.count("*").alias("n"), F.sum(F.length(F.coalesce("aa_seq", F.lit("")))).alias("residues"), F.sum(F.col("redundancy").cast("long")).alias("reads"), F.min(F.col("doc_id").cast("long")).alias("first_id"), F.max(F.sha2(text, 256)).alias("last_digest"))
    return rows.groupBy("v_call", "j_call", "anarci_status", "productive", F.col("_meta")["Species"].alias("species")).agg(*totals)
