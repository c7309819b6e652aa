"""Ledger, plate store, verification, references, protocol steps, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dna, imgt, wells
from ..functions import germline as g
from ..operators import alignment, assign, hits, ledger, plates, protocol, reference, runs, sequencing, stores
from ..operators import pool as op
from ..operators.storage import LOCAL
from ..sinks import alignments, forms, orders, worklists
from ..sources import fasta
from . import derive as d
from .assay_queries import _HEALTH, _TRUTH
from .catalog import query

_R6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- ledger

_DAG = "SELECT c_custkey // 2 AS parent_id, c_custkey AS child_id FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey > 0"


def _dag(spark, sf):
    """Every customer was made from two others: a graph in which many paths meet."""
    c = d.table(spark, sf, "customer").where("c_custkey > 0")
    return c.select(F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("parent_id"), F.col("c_custkey").alias("child_id"), F.lit("made").alias("relationship")).distinct()


@query(f"""
    WITH RECURSIVE l AS ({_DAG}), a(start, obj_id, depth) AS (SELECT child_id, parent_id, 1 FROM l UNION SELECT a.start, l.parent_id, a.depth + 1 FROM a JOIN l ON a.obj_id = l.child_id)
    SELECT start, obj_id, CAST(min(depth) AS INTEGER) AS depth FROM a GROUP BY 1, 2
""")
def lineage_up(spark, sf):
    """All ancestors of every artifact, at the least depth."""
    return ledger.lineage(_dag(spark, sf), d.table(spark, sf, "customer").select(F.col("c_custkey").alias("obj_id")))


@query(f"SELECT child_id AS obj_id, count(*) AS n, min(parent_id) AS least FROM ({_DAG}) GROUP BY 1")
def ledger_parents(spark, sf):
    ids = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("obj_id"))
    return ledger.parents(_dag(spark, sf), ids).groupBy("obj_id").agg(F.count("*").alias("n"), F.min("parent_id").alias("least"))


@query(f"SELECT parent_id AS obj_id, count(*) AS n, max(child_id) AS greatest FROM ({_DAG}) WHERE parent_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def ledger_children(spark, sf):
    ids = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("obj_id"))
    return ledger.children(_dag(spark, sf), ids).groupBy("obj_id").agg(F.count("*").alias("n"), F.max("child_id").alias("greatest"))


@query("SELECT o_orderkey AS obj_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'old' ELSE 'new' END AS label FROM orders")
def ledger_register(spark, sf):
    """Urgent orders are registered already; registering all adds the others, and the old rows stay."""
    o = d.table(spark, sf, "orders")
    rows = lambda frame, label: frame.select(F.col("o_orderkey").alias("obj_id"), F.lit(label).alias("label"))
    return ledger.register(rows(o.where("o_orderpriority = '1-URGENT'"), "old"), rows(o, "new"))


@query("SELECT DISTINCT l_orderkey AS parent_id, l_partkey AS child_id, CASE WHEN l_returnflag = 'N' THEN 'made' ELSE 'used' END AS relationship FROM lineitem")
def ledger_link(spark, sf):
    """Links repeat in what is there, in what is new, and between both; each is kept once."""
    l = d.table(spark, sf, "lineitem")  # noqa: E741
    rows = l.select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("child_id"), F.when(F.col("l_returnflag") == "N", "made").otherwise("used").alias("relationship"))
    return ledger.link(rows.where("relationship = 'made'").distinct(), rows)


@query("SELECT event_id AS obj_id, CASE WHEN event_type = 'error' THEN 'set' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_type = 'error' THEN 'yes' END AS seen FROM events")
def ledger_set_meta(spark, sf):
    e = d.table(spark, sf, "events")
    changes = e.where("event_type = 'error'").select(F.col("event_id").alias("obj_id"), F.explode(F.create_map(F.lit("k"), F.lit("set"), F.lit("seen"), F.lit("yes"))).alias("key", "value"))
    out = ledger.set_meta(e.select(F.col("event_id").alias("obj_id"), F.col("props").alias("meta_json")), changes)
    return out.select("obj_id", F.get_json_object("meta_json", "$.k").alias("k"), F.get_json_object("meta_json", "$.seen").alias("seen"))


@query("SELECT DISTINCT o_custkey AS obj_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ledger_supersede(spark, sf):
    """Customers with a finished order are superseded by that; the others are current."""
    o = d.table(spark, sf, "orders")
    links = ledger.supersede(spark.createDataFrame([], "parent_id long, child_id long, relationship string"), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("old_id"), F.col("o_orderkey").alias("new_id")))
    return ledger.current(o.select(F.col("o_custkey").alias("obj_id")).distinct(), links)


# ---------------------------------------------------------------- plates

_WELLS = "SELECT DISTINCT l_orderkey % 300 AS plate_id, l_partkey % 8 AS well FROM lineitem WHERE l_partkey % 5 <> 0"


def _wells(spark, sf):
    l = d.table(spark, sf, "lineitem").where("l_partkey % 5 <> 0")  # noqa: E741
    return l.select((F.col("l_orderkey") % 300).alias("plate_id"), (F.col("l_partkey") % 8).alias("well")).distinct().withColumn("clone_id", F.concat(F.lit("CLN-"), ((F.col("plate_id") * 8 + F.col("well")) % 50).cast("string")))


@query(f"""
    SELECT r.plate_id, r.well, value, CASE WHEN w.plate_id IS NOT NULL THEN concat('CLN-', (r.plate_id * 8 + r.well) % 50) END AS clone_id
    FROM (SELECT l_orderkey % 300 AS plate_id, l_suppkey % 8 AS well, l_quantity AS value FROM lineitem WHERE l_returnflag = 'R') r LEFT JOIN ({_WELLS}) w ON r.plate_id = w.plate_id AND r.well = w.well
""")
def read_values(spark, sf):
    l = d.table(spark, sf, "lineitem")  # noqa: E741
    reads = l.select((F.col("l_orderkey") % 300).alias("plate_id"), (F.col("l_suppkey") % 8).alias("well"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    return plates.read_values(reads, _wells(spark, sf), "R").select("plate_id", "well", "value", "clone_id")


@query(f"SELECT w.plate_id, well, n FROM ({_WELLS}) w JOIN (SELECT o_custkey % 300 AS plate_id, count(*) AS n FROM orders GROUP BY 1) USING (plate_id) WHERE (w.plate_id * 8 + well) % 50 = 7")
def where_is(spark, sf):
    heads = d.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 300).alias("plate_id")).agg(F.count("*").alias("n"))
    return plates.where_is(_wells(spark, sf), heads, "CLN-7").select("plate_id", "well", "n")


@query("SELECT o_orderkey AS plate_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS state FROM orders WHERE o_custkey % 20 = 3")
def states_of(spark, sf):
    heads = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("plate_id"), (F.col("o_custkey") % 20).cast("string").alias("barcode"), F.col("o_orderdate").alias("created_at"))
    return plates.states_of(heads, "3").select("plate_id", F.col("state").cast("long").alias("state"))


@query("""
    SELECT concat('PLT-', o_custkey) AS plate_id, concat('BC', o_orderkey % 40) AS barcode, o_orderpriority AS content_kind, strftime(o_orderdate, '%Y-%m-%d') AS created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderkey DESC) AS r FROM orders) WHERE r = 1
""")
def plate_store(spark, sf):
    """Heads of plates written to a store in two rounds, each by its latest row; a plate that the second round has is that round's."""
    one = d.table(spark, sf, "orders").withColumn("late", F.col("o_orderstatus") != "F").groupBy("o_custkey", "late").agg(F.max(F.struct("o_orderkey", "o_orderpriority", "o_orderdate")).alias("r"))
    rows = one.select("late", F.concat(F.lit("PLT-"), F.col("o_custkey").cast("string")).alias("plate_id"), F.concat(F.lit("BC"), (F.col("r.o_orderkey") % 40).cast("string")).alias("barcode"), F.col("r.o_orderpriority").alias("content_kind"), F.date_format("r.o_orderdate", "yyyy-MM-dd").alias("created_at"))
    store = stores.connect(spark, "assay", f"{spark.conf.get('spark.checkpoint.dir', None) or LOCAL}/store-{uuid.uuid4().hex}")
    for late in (False, True):
        store.put("plates", rows.where(F.col("late") == late).drop("late"))
    return stores.find_plates(store.table("plates")).select("plate_id", "barcode", "content_kind", "created_at")


@query(f"""
    SELECT pair_id AS plate_id, chr(CAST(65 + place % 8 AS INT)) AS row, {", ".join(f"max(od450_target) FILTER (place // 8 + 1 = {c}) AS c{c}" for c in range(1, 13))} FROM ({d.CELLS_SQL}) GROUP BY 1, 2
""")
def plate_matrix(spark, sf):
    rows = d.cells(spark, sf).select(F.col("pair_id").alias("plate_id"), "well", "od450_target", F.lit("sample").alias("role"))
    return wells.matrix(rows, "od450_target").withColumnsRenamed({str(c): f"c{c}" for c in range(1, 13)})


@query("SELECT CAST(65 + l_partkey % 8 - 64 AS INTEGER) AS row, CAST(1 + l_suppkey % 12 AS INTEGER) AS col, count(*) AS n FROM lineitem GROUP BY 1, 2")
def well_places(spark, sf):
    well = F.concat(F.lower(F.char((65 + F.col("l_partkey") % 8).cast("int"))), F.lit(" "), (1 + F.col("l_suppkey") % 12).cast("string"))
    return d.table(spark, sf, "lineitem").select(wells.to_rc(well).alias("rc")).groupBy("rc.row", "rc.col").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- hit calling

#: Pairs without blanks of their own, as a verdict's context is measured.
_CONTEXT = f"""
    WITH p AS ({d.PAIRS_SQL}), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY pair_id ORDER BY od450_target, well) AS up, row_number() OVER (PARTITION BY pair_id ORDER BY od450_target DESC, well) AS down FROM p WINDOW w AS (PARTITION BY pair_id))
    SELECT pair_id, avg(od450_target) FILTER (down <= greatest(1, n // 10)) / median(od450_target) FILTER (up <= greatest(3, n // 10)) AS dynamic_range, avg(CASE WHEN od450_target >= 3.6 THEN 1.0 ELSE 0.0 END) AS saturated, count(*) FILTER ({_TRUTH}) AS binders FROM r GROUP BY 1
"""


def _truth(spark, sf):
    return d.pairs(spark, sf).select("pair_id", "well", F.expr(_TRUTH).alias("is_binder"))


@query(f"SELECT pair_id, round(dynamic_range, 6) AS dynamic_range, round(saturated, 6) AS saturated, binders FROM ({_CONTEXT})")
def plate_context(spark, sf):
    return hits.plate_context(d.pairs(spark, sf), _truth(spark, sf)).withColumns({"dynamic_range": _R6("dynamic_range"), "saturated": _R6("saturated")})


#: One caller on every pair, nobody refusing.
_FREE = f"""
    {_HEALTH}, l AS (SELECT pair_id, verdict, ratio_over_blank AS is_hit, {_TRUTH} AS is_binder FROM k),
    t AS (SELECT pair_id, any_value(verdict) AS verdict, count(*) FILTER (is_hit AND is_binder) AS tp, count(*) FILTER (is_hit AND NOT is_binder) AS fp, count(*) FILTER (NOT is_hit AND is_binder) AS fn FROM l GROUP BY 1),
    f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM t)
"""
_RATES = 'round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1'


def _free(spark, sf):
    return hits.evaluate(d.pairs(spark, sf), _truth(spark, sf), d.blanks(spark, sf), ["ratio_over_blank"], respect_verdict=False)


def _rounded(rows):
    return rows.withColumns({c: _R6(c) for c in ("precision", "recall", "f1")})


@query(f"{_FREE} SELECT verdict, {_RATES}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, count(*) AS plates FROM f GROUP BY 1")
def verdict_table(spark, sf):
    """What a verdict was worth: one caller, so that a plate counts once."""
    return _rounded(hits.verdict_table(_free(spark, sf)))


@query(f"{_FREE} SELECT CASE WHEN s <= 0.02 THEN 0 WHEN s <= 0.1 THEN 1 WHEN s <= 0.2 THEN 2 ELSE 3 END AS band, {_RATES}, count(*) AS plates FROM f JOIN (SELECT pair_id, saturated AS s FROM ({_CONTEXT}) WHERE binders > 0) USING (pair_id) GROUP BY 1")
def saturation_bands(spark, sf):
    context = hits.plate_context(d.pairs(spark, sf), _truth(spark, sf))
    return _rounded(hits.band_table(_free(spark, sf), context, "saturated", hits.SATURATION_BANDS))


@query(f"{_HEALTH} SELECT pair_id, (verdict <> 'callable')::INT + (saturated > 0)::INT AS n, verdict = 'uncallable' AS refused FROM v")
def health_reasons(spark, sf):
    told = hits.reasons(hits.plate_health(d.pairs(spark, sf), d.blanks(spark, sf)))
    return told.select("pair_id", F.size("reasons").alias("n"), F.exists("reasons", lambda r: F.contains(r, F.lit("no range"))).alias("refused"))


# ---------------------------------------------------------------- protocol

_SOURCE = "SELECT DISTINCT l_orderkey AS plate, l_linenumber AS well, CASE WHEN l_linenumber = 1 THEN 'empty' ELSE 'sample' END AS role, CASE WHEN l_linenumber % 3 <> 0 THEN max(l_quantity) END AS v FROM lineitem GROUP BY 1, 2"
_STEP_SQL = {"transfect": ("1000.0", "5.0"), "harvest_supernatant": ("800.0", "800.0"), "add_beads": ("coalesce(v, 0) + 20.0", "0.0::DOUBLE"), "immunoprecipitate": ("v", "0.0::DOUBLE"), "elute_neutralise": ("55.0", "0.0::DOUBLE"), "magnet_transfer": ("50.0", "50.0")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS step, role, count(*) AS n, round(sum(CASE WHEN role = 'sample' THEN {volume} END), 4) AS volume_ul, round(sum(CASE WHEN role = 'sample' THEN {moved} ELSE 0.0::DOUBLE END), 4) AS moved_ul FROM ({_SOURCE}) GROUP BY 2" for name, (volume, moved) in _STEP_SQL.items()))
def protocol_steps(spark, sf):
    """What the six steps that keep the layout give each well, over all plates."""
    l = d.table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("well")).agg(F.max("l_quantity").alias("q"))  # noqa: E741
    source = l.select("l_orderkey", "well", F.when(F.col("well") == 1, "empty").otherwise("sample").alias("role"), F.lit("c").alias("clone_id"), F.when(F.col("well") % 3 != 0, F.col("q")).alias("volume_ul"))
    out = None
    for name in _STEP_SQL:
        made = protocol.STEPS.get(name)().wells(source).groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum("volume_ul"), 4).alias("volume_ul"), F.round(F.sum("moved_ul"), 4).alias("moved_ul")).select(F.lit(name).alias("step"), "role", "n", "volume_ul", "moved_ul")
        out = made if out is None else out.unionByName(made)
    return out


# ---------------------------------------------------------------- verification

_STRANDS = "SELECT item_id, s, CASE WHEN item_id % 2 = 0 THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS r FROM (SELECT item_id, {} AS s FROM benchmark)".format(d.DNA_SQL)
_KMERS = "SELECT DISTINCT {id}, {more} substr({s}, CAST(p AS BIGINT), 12) AS kmer FROM (SELECT *, unnest(range(1, length({s}) - 10)) AS p FROM {t} WHERE length({s}) >= 12)"


@query(f"""
    WITH b AS ({_STRANDS}), q AS (SELECT item_id, '+' AS strand, r AS x FROM b UNION ALL SELECT item_id, '-', reverse(translate(r, 'ACGT', 'TGCA')) FROM b),
    refs AS ({_KMERS.format(id="item_id AS ref_id", more="", s="s", t="b")}), reads AS ({_KMERS.format(id="item_id AS read_id", more="strand,", s="x", t="q")}),
    n AS (SELECT read_id, ref_id, strand, count(*) AS shared FROM reads JOIN refs USING (kmer) GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY read_id, ref_id ORDER BY shared DESC, strand) AS r FROM n), z AS (SELECT read_id, ref_id, shared, strand, row_number() OVER (PARTITION BY read_id ORDER BY shared DESC, ref_id) AS place FROM o WHERE r = 1)
    SELECT * FROM z WHERE place <= 3
""")
def strand_screen(spark, sf):
    """Items, every other one reversed, against all items on both strands."""
    rows = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), d.bases().alias("seq"))
    reads = rows.select(F.col("ref_id").alias("read_id"), F.when(F.col("ref_id") % 2 == 0, F.col("seq")).otherwise(dna.reverse_complement(F.col("seq"))).alias("seq"))
    return sequencing.screen(reads, rows)


@query("""
    SELECT p_partkey AS file, max_by(word, length(word)) AS clone_id FROM part LEFT JOIN (SELECT DISTINCT substr(p_name, 1, n) AS word FROM part, (SELECT unnest([3, 5, 8]) AS n)) ON starts_with(p_name, word) GROUP BY 1
""")
def match_by_sample(spark, sf):
    """A trace's sample begins with the clone's name; the longest such name holds."""
    p = d.table(spark, sf, "part")
    names = p.select(F.explode(F.array(*[F.substring("p_name", 1, n) for n in (3, 5, 8)])).alias("clone_id")).distinct().withColumns({"well": F.lit("A01"), "insert": F.lit("")})
    return sequencing.match_traces(p.select(F.col("p_partkey").alias("file"), F.col("p_name").alias("stem")), names, "sample").select("file", "clone_id")


@query("SELECT l_orderkey AS file, l_linenumber AS line, n.n_name AS clone_id FROM lineitem l LEFT JOIN nation n ON n.n_nationkey = l.l_suppkey % 40")
def match_by_well(spark, sf):
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("well"), F.col("n_name").alias("clone_id"))
    traces = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 40).alias("well"))
    return sequencing.match_traces(traces, n).select("file", "line", "clone_id")


@query("""
    SELECT well, clone_id, insert FROM (SELECT concat(chr(CAST(65 + s_suppkey % 8 AS INT)), lpad(CAST(1 + s_suppkey // 8 % 12 AS VARCHAR), 2, '0')) AS well, s_name AS clone_id, upper(s_name) AS insert, row_number() OVER (PARTITION BY s_suppkey % 96 ORDER BY s_suppkey DESC) AS r FROM supplier) WHERE r = 1
""")
def expectations(spark, sf):
    """Of several clones of a well the last one is expected."""
    s = d.table(spark, sf, "supplier")
    well = F.concat(F.char((65 + F.col("s_suppkey") % 8).cast("int")), (1 + F.floor(F.col("s_suppkey") / 8) % 12).cast("string"))
    rows = s.select(well.alias("well"), F.col("s_name").alias("clone_id"), F.col("s_name").alias("insert_dna_seq"), F.col("s_suppkey").alias("ordinal"))
    return sequencing.expectations_from(rows).select("well", "clone_id", "insert")


_VERDICT = "CASE CAST(l_linenumber AS INT) WHEN 1 THEN 'exact' WHEN 2 THEN 'silent' WHEN 3 THEN 'missense' WHEN 4 THEN 'frameshift' WHEN 5 THEN 'mixed' ELSE 'unreadable' END"


def _verdicts(spark, sf):
    return d.table(spark, sf, "lineitem").select((F.col("l_partkey") % 96).alias("well"), F.expr(_VERDICT).alias("verdict"))


@query(f"SELECT verdict, count(*) AS n, verdict IN ('exact', 'silent') AS usable FROM (SELECT {_VERDICT} AS verdict FROM lineitem) GROUP BY 1")
def verdict_summary(spark, sf):
    return sequencing.summarise(_verdicts(spark, sf)).select("verdict", "n", "usable")


@query("SELECT DISTINCT l_partkey % 96 AS well FROM lineitem WHERE l_linenumber <= 2")
def usable_wells(spark, sf):
    return sequencing.usable_wells(_verdicts(spark, sf))


@query("SELECT doc_id, round(CASE WHEN t = '' THEN 0 ELSE (length(t) - length(regexp_replace(t, '[RYSWKMBDHV]', '', 'g'))) / length(t) END, 9) AS mixed FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS t FROM documents WHERE text IS NOT NULL)")
def mixed_fraction(spark, sf):
    return d.texts(spark, sf).where("text IS NOT NULL").select("doc_id", F.round(dna.mixed_fraction(F.col("text")), 9).alias("mixed"))


@query("""
    WITH p AS (SELECT p_partkey, upper(p_name) AS a, upper(lag(p_name) OVER (ORDER BY p_partkey)) AS b FROM part), q AS (SELECT * FROM p WHERE b IS NOT NULL)
    SELECT p_partkey, array_to_string(list_concat(list_filter(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN substr(a, CAST(i AS BIGINT), 1) <> substr(b, CAST(i AS BIGINT), 1) THEN concat(substr(a, CAST(i AS BIGINT), 1), i, substr(b, CAST(i AS BIGINT), 1)) END), lambda x: x IS NOT NULL),
           CASE WHEN length(a) <> length(b) THEN [concat('length ', length(a), '->', length(b))] ELSE [] END), ',') AS changes FROM q
""")
def protein_changes(spark, sf):
    p = d.table(spark, sf, "part")
    both = p.select("p_partkey", F.upper("p_name").alias("a")).join(p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.upper("p_name").alias("b")), "p_partkey")
    return both.select("p_partkey", F.array_join(dna.protein_changes(F.col("a"), F.col("b")), ",").alias("changes"))


@query("SELECT c_custkey, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS distance FROM (SELECT c_custkey, c_name AS a, concat(c_mktsegment, c_custkey) AS b FROM customer)")
def sequence_distance(spark, sf):
    c = d.table(spark, sf, "customer")
    return c.select("c_custkey", F.round(g.distance(F.col("c_name"), F.concat("c_mktsegment", F.col("c_custkey").cast("string"))), 9).alias("distance"))


@query("""
    WITH c AS (SELECT conv_id, turn, upper(text) AS s FROM conversations), k AS (SELECT DISTINCT conv_id, turn, substr(s, CAST(p AS BIGINT), 6) AS kmer FROM (SELECT *, unnest(range(1, length(s) - 4)) AS p FROM c WHERE length(s) >= 6)), u AS (SELECT * FROM k WHERE NOT contains(kmer, 'N'))
    SELECT c.conv_id, c.turn, count(b.kmer) AS shared FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 LEFT JOIN u a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN u b ON b.conv_id = n.conv_id AND b.turn = n.turn AND b.kmer = a.kmer GROUP BY 1, 2
""")
def shared_kmers(spark, sf):
    """Distinct 6-mers of each turn that the next turn has."""
    c = d.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    both = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.coalesce(dna.shared_kmers(F.col("text"), F.col("next"), 6), F.lit(0)).cast("long").alias("shared"))


# ---------------------------------------------------------------- pool and references


@query(f"""
    SELECT concat('SEQ-', substr(sha256(concat('unit|', aa)), 1, 12)) AS seq_id, v_gene, v_family, chain, aa AS aa_seq, CAST(length(cdr3_aa) AS INTEGER) AS cdr3_len, has_liability, CAST(n_ambiguous AS INTEGER) AS n_ambiguous, CAST(coalesce(redundancy, 1) AS INTEGER) AS redundancy, 'human' AS species
    FROM (SELECT *, aa_seq AS aa FROM ({d.POOL_SQL}))
""")
def pool_normalize(spark, sf):
    """Rearrangement rows with gaps in the pool's columns."""
    raw = d.repertoire(spark, sf).select(F.regexp_replace("aa_seq", "^(.{3})", "$1-.").alias("sequence_alignment_aa"), "cdr3_aa", "v_call", "j_call", "productive", F.col("anarci_status").alias("ANARCI_status"), F.col("redundancy").cast("string").alias("Redundancy"))
    return op.normalize(raw, {"Species": "human"}, "unit").select("seq_id", "v_gene", "v_family", "chain", "aa_seq", "cdr3_len", "has_liability", "n_ambiguous", "redundancy", "species")


@query("SELECT DISTINCT l_orderkey AS seq_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def store_repair(spark, sf):
    heap = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq_id"))
    return op.repaired(heap, d.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("seq_id")))


_GAPPED = f"SELECT doc_id, concat(substr(aa_seq, 1, 1), '-', substr(aa_seq, 3, 4)) AS s, substr(aa_seq, 2, 6) AS g, v_gene FROM ({d.POOL_SQL}) WHERE length(aa_seq) >= 7"
_PLACES = "[('1', 1), ('111', 3), ('112B', 4), ('112A', 5), ('112', 6)]"


def _gapped(spark, sf):
    """Six columns of each sequence, the second a gap, with the numbering of the other five and a germline beside."""
    p = d.pool(spark, sf).where("length(aa_seq) >= 7")
    letter = lambda i: F.substring("aa_seq", i, 1)
    numbering = F.concat(F.lit("{'fwh1': {'1 ': '"), letter(1), F.lit("'}, 'cdrh3': {'112 ': '"), letter(6), F.lit("', '111 ': '"), letter(3), F.lit("', '112B': '"), letter(4), F.lit("', '112A': '"), letter(5), F.lit("'}}"))
    return p.select("seq_id", "v_gene", numbering.alias("anarci_numbering"), F.concat(letter(1), F.lit("-"), F.substring("aa_seq", 3, 4)).alias("aa_gapped"), F.substring("aa_seq", 2, 6).alias("germline_aa"))


@query(f"SELECT concat('SEQ-', doc_id) AS seq_id, x[1] AS position, substr(g, x[2], 1) AS residue FROM ({_GAPPED}), (SELECT unnest({_PLACES}) AS x)")
def germline_columns(spark, sf):
    return reference.germline_by_column(_gapped(spark, sf))


@query(f"""
    SELECT position, residue, votes FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY votes DESC, residue) AS r FROM (SELECT x[1] AS position, substr(g, x[2], 1) AS residue, count(*) AS votes FROM ({_GAPPED}), (SELECT unnest({_PLACES}) AS x) GROUP BY 1, 2)) WHERE r = 1
""")
def germline_row(spark, sf):
    return reference.germline_row(_gapped(spark, sf))


@query(f"""
    WITH v AS (SELECT v_gene, g, count(*) AS k FROM ({_GAPPED}) GROUP BY 1, 2)
    SELECT v_gene, g AS reference, CASE WHEN n = 1 THEN 'germline' ELSE concat('germline (modal of ', n, ')') END AS label FROM (SELECT *, count(*) OVER (PARTITION BY v_gene) AS n, row_number() OVER (PARTITION BY v_gene ORDER BY k DESC, g) AS r FROM v) WHERE r = 1
""")
def reference_row(spark, sf):
    return reference.reference_row(_gapped(spark, sf))


@query(f"""
    SELECT seq_id, 'FR1' AS region, 0 AS first, 1 AS last FROM (SELECT concat('SEQ-', doc_id) AS seq_id FROM ({_GAPPED})) UNION ALL SELECT concat('SEQ-', doc_id), 'CDR3', CASE WHEN strpos(substr(replace(s, '-', ''), 2), substr(s, 4, 2)) > 0 THEN strpos(substr(replace(s, '-', ''), 2), substr(s, 4, 2)) + 1 ELSE 0 END,
           CASE WHEN strpos(substr(replace(s, '-', ''), 2), substr(s, 4, 2)) > 0 THEN strpos(substr(replace(s, '-', ''), 2), substr(s, 4, 2)) + 3 ELSE 0 END FROM ({_GAPPED})
""")
def region_spans(spark, sf):
    """The first residue and the fourth and fifth letter as regions, found again in the gapped row."""
    rows = _gapped(spark, sf)
    regions = {"FR1": F.substring("aa_gapped", 1, 1), "CDR1": F.lit(None).cast("string"), "CDR3": F.substring("aa_gapped", 4, 2)}
    return rows.select("seq_id", F.explode(reference.region_spans(F.col("aa_gapped"), regions)).alias("x")).select("seq_id", "x.region", "x.first", "x.last")


_TABLE_SQL = f"SELECT v_gene AS gene, concat(v_gene, '*0', 1 + doc_id % 3) AS allele, aa_seq AS s, doc_id FROM ({d.POOL_SQL}) WHERE length(aa_seq) >= 5 AND v_gene LIKE 'IGHV%'"


def _germlines(spark, sf):
    """A germline table: of each allele the row of the least id, a gap after its second residue."""
    p = d.pool(spark, sf).where("length(aa_seq) >= 5 AND v_gene LIKE 'IGHV%'")
    rows = p.groupBy(F.concat("v_gene", F.lit("*0"), (1 + F.col("doc_id") % 3).cast("string")).alias("allele")).agg(F.min_by("aa_seq", "doc_id").alias("s"))
    return rows.select(F.lit("V").alias("kind"), F.lit("H").alias("chain"), F.lit("human").alias("species"), "allele", F.concat(F.substring("s", 1, 2), F.lit(".."), F.expr("substring(s, 3)")).alias("gapped"))


@query(f"""
    SELECT gene, allele, s AS sequence, CAST(length(s) AS BIGINT) AS n, CAST(length(s) + 2 AS BIGINT) AS last FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY allele, doc_id) AS r FROM ({_TABLE_SQL})) WHERE r = 1
""")
def germline_lookup(spark, sf):
    """The lowest allele of each gene, with the numbers of its residues."""
    genes = d.pool(spark, sf).select(F.col("v_gene").alias("gene"))
    return reference.lookup(_germlines(spark, sf), genes).select("gene", "allele", "sequence", F.size("numbers").cast("long").alias("n"), F.element_at("numbers", -1).cast("long").alias("last"))


@query(f"SELECT DISTINCT gene FROM ({_TABLE_SQL})")
def known_genes(spark, sf):
    return reference.known_genes(_germlines(spark, sf))


@query(f"""
    WITH t AS (SELECT gene, s FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY allele, doc_id) AS r FROM ({_TABLE_SQL})) WHERE r = 1), p AS (SELECT DISTINCT v_gene AS gene FROM ({d.POOL_SQL}) UNION SELECT 'IGHV9-99')
    SELECT gene, s IS NOT NULL OR gene LIKE 'IGK%' AS resolved, CASE WHEN s IS NOT NULL THEN 'table' WHEN gene LIKE 'IGK%' THEN 'pool' END AS source, CASE WHEN s IS NOT NULL THEN CAST(length(s) AS INTEGER) WHEN gene LIKE 'IGK%' THEN 3 ELSE 0 END AS length, CASE WHEN s IS NOT NULL THEN false WHEN gene LIKE 'IGK%' THEN true END AS derived FROM p LEFT JOIN t USING (gene)
""")
def germline_coverage(spark, sf):
    pool = d.pool(spark, sf).select(F.col("v_gene").alias("gene")).distinct()
    every = pool.unionByName(spark.createDataFrame([("IGHV9-99",)], "gene string"))
    seen = pool.where("gene LIKE 'IGK%'").withColumn("sequence", F.lit("AAA"))
    return reference.coverage_report(every, [("table", reference.lookup(_germlines(spark, sf), every)), ("pool", seen)])


@query(f"SELECT v_gene, j AS j_gene FROM (SELECT v_gene, split_part(j_call, '*', 1) AS j, row_number() OVER (PARTITION BY v_gene ORDER BY count(*) DESC, split_part(j_call, '*', 1)) AS r FROM ({d.POOL_SQL}) GROUP BY 1, 2) WHERE r = 1")
def modal_j(spark, sf):
    return reference.modal_j(d.pool(spark, sf).withColumn("j_gene", g.gene(F.col("j_call"))))


@query("SELECT gene, sequence, source FROM (SELECT DISTINCT p_brand AS gene FROM part) LEFT JOIN (SELECT p_brand AS gene, min(p_type) AS sequence, 'first' AS source FROM part WHERE p_size > 45 GROUP BY 1) USING (gene)")
def germline_resolve(spark, sf):
    p = d.table(spark, sf, "part")
    first = p.where("p_size > 45").groupBy(F.col("p_brand").alias("gene")).agg(F.min("p_type").alias("sequence"))
    return fasta.resolve(p.select(F.col("p_brand").alias("gene")), [("none", first.limit(0)), ("first", first)])


# ---------------------------------------------------------------- sinks and assignments


@query(f"SELECT seq_id, concat('>', seq_id, chr(10), aa_seq) AS line FROM (SELECT concat('SEQ-', doc_id) AS seq_id, aa_seq FROM ({d.REPERTOIRE_SQL})) WHERE aa_seq IS NOT NULL")
def fasta_lines(spark, sf):
    return alignments.as_fasta(d.pool(spark, sf).where("aa_seq IS NOT NULL"), "seq_id", "aa_seq")


_WELL = "concat(chr(CAST(65 + {0} % 96 % 8 AS INT)), lpad(CAST(1 + {0} % 96 // 8 AS VARCHAR), 2, '0'))"


@query(f"SELECT line, count(*) AS n FROM (SELECT concat({_WELL.format('l_partkey')}, ',', {_WELL.format('l_suppkey')}, ',', printf('%.2f', l_quantity)) AS line FROM lineitem) GROUP BY 1")
def generic_worklist(spark, sf):
    return worklists.emit(d.transfers(spark, sf), "generic").groupBy("line").agg(F.count("*").alias("n"))


@query(f"""SELECT line, count(*) AS n FROM (SELECT concat('    pipette.transfer(', printf('%.2f', l_quantity), ', source["', {_WELL.format('l_partkey')}, '"], destination["', {_WELL.format('l_suppkey')}, '"])') AS line FROM lineitem) GROUP BY 1""")
def opentrons_lines(spark, sf):
    return worklists.emit(d.transfers(spark, sf), "opentrons", allow_unverified=True).groupBy("line").agg(F.count("*").alias("n"))


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k AS sub, line FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([0, 1, 2]) AS k, unnest([concat('A;Source;;;', l_partkey % 96 + 1, ';;', printf('%.2f', l_quantity), ';;;;'), concat('D;Destination;;;', l_suppkey % 96 + 1, ';;', printf('%.2f', l_quantity), ';;;;'), 'W1;']) AS line FROM lineitem)
""")
def worklist_order(spark, sf):
    """Every line with the place that it is written in."""
    return worklists.emit(d.transfers(spark, sf), "tecan_evo", allow_unverified=True).select("ordinal.l_orderkey", "ordinal.l_linenumber", "ordinal.l_partkey", "ordinal.l_suppkey", "sub", "line")


@query(f"SELECT {_WELL.format('s_suppkey')} AS well, s_name AS sample_name, 'T7' AS primer, '' AS length_bp, '' AS concentration_ng_ul, '' AS clone_id FROM supplier")
def form_generic(spark, sf):
    s = d.table(spark, sf, "supplier")
    return forms.order(s.select(wells.at_column_major(F.col("s_suppkey") % 96 + 1).alias("well"), F.col("s_name").alias("sample_name")), "generic", primer="T7")


@query(f"SELECT doc_id AS name, md5({d.DNA_SQL}) AS digest, CAST(length({d.DNA_SQL}) AS BIGINT) AS length, round(CASE WHEN {d.DNA_SQL} = '' THEN 0 ELSE length(regexp_replace({d.DNA_SQL}, '[^GC]', '', 'g')) / length({d.DNA_SQL}) END, 3) AS gc FROM documents WHERE text IS NOT NULL")
def vendor_table(spark, sf):
    rows = d.texts(spark, sf).where("text IS NOT NULL").select("doc_id", d.bases().alias("s"))
    return orders.emit(rows, "generic", name="doc_id", seq="s").select("name", F.md5("sequence").alias("digest"), "length", "gc")


_ASSIGNED = "SELECT event_id AS grid_id, CASE event_type WHEN 'click' THEN 'barcode' WHEN 'view' THEN 'name' WHEN 'error' THEN 'unresolved' ELSE 'model' END AS source, round(value / 1000, 6) AS confidence FROM events"


def _assigned(spark, sf):
    return d.table(spark, sf, "events").selectExpr("event_id AS grid_id", "CASE event_type WHEN 'click' THEN 'barcode' WHEN 'view' THEN 'name' WHEN 'error' THEN 'unresolved' ELSE 'model' END AS source", "round(value / 1000, 6) AS confidence")


@query(f"SELECT source, count(*) AS grids, count(*) FILTER (source IN ('barcode', 'name')) AS confirmed, min(confidence) AS least_confidence FROM ({_ASSIGNED}) GROUP BY 1")
def assignment_report(spark, sf):
    return assign.report(_assigned(spark, sf))


@query(f"SELECT grid_id FROM ({_ASSIGNED}) WHERE source IN ('model', 'unresolved')")
def assignment_unresolved(spark, sf):
    return assign.unresolved(_assigned(spark, sf)).select("grid_id")


@query(f"SELECT v_gene, count(*) AS n, min(cdr3_len) AS cdr3_len_min, max(cdr3_len) AS cdr3_len_max, median(cdr3_len) AS cdr3_len_median FROM ({d.POOL_SQL}) GROUP BY 1")
def selection_pool_summary(spark, sf):
    return runs.pool_summary(d.pool(spark, sf))


@query(f"""
    SELECT seq_id, v_gene FROM (SELECT concat('SEQ-', doc_id) AS seq_id, v_gene, aa_seq, row_number() OVER (PARTITION BY v_gene ORDER BY cdr3_len NULLS LAST, concat('SEQ-', doc_id)) AS r FROM ({d.POOL_SQL})) WHERE r <= 50 AND trim(aa_seq) <> ''
""")
def rows_to_align(spark, sf):
    """The first rows of each gene by loop length, which an alignment shows."""
    return alignment.rows_to_align(d.pool(spark, sf)).select("seq_id", "v_gene")


@query("SELECT CAST(n AS INTEGER) AS n, CASE WHEN n <= 26 THEN 'FR1' WHEN n <= 38 THEN 'CDR1' WHEN n <= 55 THEN 'FR2' WHEN n <= 65 THEN 'CDR2' WHEN n <= 104 THEN 'FR3' WHEN n <= 117 THEN 'CDR3' WHEN n <= 128 THEN 'FR4' END AS region FROM (SELECT DISTINCT 1 + l_partkey % 130 AS n FROM lineitem)")
def region_of_numbers(spark, sf):
    return d.table(spark, sf, "lineitem").select((1 + F.col("l_partkey") % 130).cast("int").alias("n")).distinct().withColumn("region", imgt.region_of(F.col("n")))
