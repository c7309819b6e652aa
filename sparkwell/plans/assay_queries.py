"""Plates, hit calling, protocol arithmetic, ledger, assignment, worklists, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wells
from ..operators import assign, hits, ledger, plates
from ..operators.storage import checkpointed
from ..sinks import forms, worklists
from . import derive as d
from .catalog import query

_R6 = lambda c: F.round(c, 6)


@query(f"SELECT *, round(od450_target / greatest(od450_control, 1e-6), 6) AS ratio, round(od450_target - od450_control, 6) AS delta FROM ({d.PAIRS_SQL})")
def pair_truth(spark, sf):
    c = d.cells(spark, sf)
    side = lambda n: c.where(f"od450_{n} IS NOT NULL").select("pair_id", "well", F.col(f"od450_{n}").alias("od450"))
    return hits.pair_truth(side("target"), side("control")).withColumns({"ratio": _R6("ratio"), "delta": _R6("delta")})


#: Per pair: background, top and verdict, as every caller has them.
_HEALTH = f"""
    WITH p AS ({d.PAIRS_SQL}), b AS (SELECT pair_id, median(od450) AS blank FROM ({d.BLANKS_SQL}) GROUP BY 1),
    r AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n, row_number() OVER (PARTITION BY pair_id ORDER BY od450_target, well) AS up, row_number() OVER (PARTITION BY pair_id ORDER BY od450_target DESC, well) AS down FROM p),
    h AS (SELECT pair_id, any_value(n) AS n_wells, median(od450_target) FILTER (up <= greatest(3, n // 10)) AS low, avg(od450_target) FILTER (down <= greatest(1, n // 10)) AS top, avg(CASE WHEN od450_target >= 3.6 THEN 1.0 ELSE 0.0 END) AS saturated FROM r GROUP BY 1),
    g AS (SELECT pair_id, n_wells, coalesce(blank, low) AS background, top, saturated FROM h LEFT JOIN b USING (pair_id)),
    v AS (SELECT *, CASE WHEN background > 0 THEN top / background ELSE 'inf'::DOUBLE END AS dynamic_range, CASE WHEN top / background < 10 THEN 'uncallable' WHEN top / background < 25 THEN 'degraded' ELSE 'callable' END AS verdict FROM g),
    m AS (SELECT pair_id, median(od450_target - od450_control) AS centre, quantile_cont(od450_target - od450_control, 0.25) AS q1, quantile_cont(od450_target - od450_control, 0.75) AS q3 FROM p GROUP BY 1),
    s AS (SELECT pair_id, any_value(centre) AS centre, median(abs(od450_target - od450_control - centre)) * 1.4826 AS mad, stddev_pop(od450_target - od450_control) FILTER (od450_target - od450_control BETWEEN q1 AND q3) AS middle FROM p JOIN m USING (pair_id) GROUP BY 1),
    c AS (SELECT p.*, verdict, background, od450_target / greatest(od450_control, 1e-6) AS ratio, (od450_target - od450_control - centre) / CASE WHEN mad <= 1e-9 THEN greatest(coalesce(middle, 0), 0.001) ELSE mad END AS z FROM p JOIN v USING (pair_id) JOIN s USING (pair_id)),
    k AS (SELECT *, ratio >= 3 AND od450_target >= 0.2 AS fixed_ratio, ratio >= 3 AND od450_target >= greatest(4 * background, 0.05) AS ratio_over_blank, z >= 3.5 AND od450_target >= 0.2 AS robust_z,
          CASE WHEN od450_target >= 3.6 THEN 'saturated' WHEN od450_target < 0.2 THEN 'below floor' ELSE '' END AS flag FROM c)
"""


@query(f"{_HEALTH} SELECT pair_id, n_wells, round(background, 6) AS background, round(top, 6) AS top, round(saturated, 6) AS saturated, round(dynamic_range, 6) AS dynamic_range, verdict FROM v")
def plate_health(spark, sf):
    out = hits.plate_health(d.pairs(spark, sf), d.blanks(spark, sf))
    return out.select("pair_id", "n_wells", *[_R6(c).alias(c) for c in ("background", "top", "saturated", "dynamic_range")], "verdict")


def _call_sql(name: str, score: str, hit: str, more: str = "") -> str:
    return f"{_HEALTH} SELECT pair_id, well, od450_target, od450_control, '{name}' AS caller, round({score}, 6) AS score, {hit} AS is_hit, flag, verdict{more} FROM k"


def _call(spark, sf, name):
    out = hits.call(d.pairs(spark, sf), name, d.blanks(spark, sf)).withColumn("score", _R6("score"))
    return out.withColumn("ratio", _R6("ratio")) if "ratio" in out.columns else out


@query(_call_sql("fixed_ratio", "ratio", "fixed_ratio"))
def call_fixed_ratio(spark, sf):
    return _call(spark, sf, "fixed_ratio")


@query(_call_sql("ratio_over_blank", "ratio", "ratio_over_blank"))
def call_ratio_over_blank(spark, sf):
    return _call(spark, sf, "ratio_over_blank")


@query(_call_sql("robust_z", "z", "robust_z"))
def call_robust_z(spark, sf):
    return _call(spark, sf, "robust_z")


@query(_call_sql("ratio_and_z", "z", "ratio_over_blank AND robust_z", ", round(ratio, 6) AS ratio"))
def call_ratio_and_z(spark, sf):
    return _call(spark, sf, "ratio_and_z")


_TRUTH = "od450_target > 2.5 AND od450_control < 1.5"
_LONG = " UNION ALL ".join(f"SELECT pair_id, '{n}' AS caller, verdict, {hit} AND verdict <> 'uncallable' AS is_hit, {_TRUTH} AS is_binder FROM k" for n, hit in (("fixed_ratio", "fixed_ratio"), ("ratio_over_blank", "ratio_over_blank"), ("robust_z", "robust_z"), ("ratio_and_z", "(ratio_over_blank AND robust_z)")))
_SCORED = f"""
    {_HEALTH}, l AS ({_LONG}),
    t AS (SELECT pair_id, caller, any_value(verdict) AS verdict, count(*) FILTER (is_hit AND is_binder) AS tp, count(*) FILTER (is_hit AND NOT is_binder) AS fp, count(*) FILTER (NOT is_hit AND is_binder) AS fn, count(*) FILTER (NOT is_hit AND NOT is_binder) AS tn, count(*) FILTER (is_binder) AS n_binders FROM l GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM t)
"""


def _scored(spark, sf):
    frame = d.pairs(spark, sf)
    return hits.evaluate(frame, frame.select("pair_id", "well", F.expr(_TRUTH).alias("is_binder")), d.blanks(spark, sf))


@query(f'{_SCORED} SELECT pair_id, caller, verdict, tp, fp, fn, tn, n_binders, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f')
def score_calls(spark, sf):
    return _scored(spark, sf).withColumns({c: _R6(c) for c in ("precision", "recall", "f1")})


@query(f"""{_SCORED} SELECT caller, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(CASE WHEN verdict = 'uncallable' THEN 1.0 ELSE 0.0 END), 6) AS refused, count(*) AS plates FROM f GROUP BY 1""")
def caller_summary(spark, sf):
    return hits.summarise(_scored(spark, sf)).withColumns({c: _R6(c) for c in ("precision", "recall", "f1", "refused")})


@query(f"""{_SCORED} SELECT CASE WHEN dynamic_range <= 6 THEN 0 WHEN dynamic_range <= 12 THEN 1 WHEN dynamic_range <= 30 THEN 2 ELSE 3 END AS band, count(DISTINCT pair_id) AS plates, round(avg(f1), 6) AS f1 FROM f JOIN (SELECT pair_id, dynamic_range FROM v) USING (pair_id) GROUP BY 1""")
def dynamic_range_bands(spark, sf):
    health = hits.plate_health(d.pairs(spark, sf), d.blanks(spark, sf)).select("pair_id", hits.band(F.col("dynamic_range"), hits.DYNAMIC_BANDS).alias("band"))
    return _scored(spark, sf).join(health, "pair_id").groupBy("band").agg(F.count_distinct("pair_id").alias("plates"), F.round(F.avg("f1"), 6).alias("f1"))


#: Readings have six places: in millionths, sums of them and of their squares are whole numbers.
_SD = "sqrt(CAST(count(*) * sum(CAST(round(od450 * 1000000) AS HUGEINT) * CAST(round(od450 * 1000000) AS HUGEINT)) - sum(CAST(round(od450 * 1000000) AS HUGEINT)) * sum(CAST(round(od450 * 1000000) AS HUGEINT)) AS DOUBLE)) / 1000000 / count(*)"
_VALUES = f"SELECT pair_id AS plate_id, well, od450_target AS od450, CASE WHEN place < 84 THEN 'sample' ELSE 'empty' END AS role FROM ({d.CELLS_SQL}) WHERE od450_target IS NOT NULL"


def _values(spark, sf):
    rows = d.cells(spark, sf).where("od450_target IS NOT NULL")
    return rows.select(F.col("pair_id").alias("plate_id"), "well", F.col("od450_target").alias("od450"), F.when(F.col("place") < 84, "sample").otherwise("empty").alias("role"))


@query(f"""
    WITH x AS ({_VALUES}), s AS (SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY od450 DESC, well) AS r, count(*) OVER (PARTITION BY plate_id) AS n, median(od450) OVER (PARTITION BY plate_id) AS med FROM x WHERE role = 'sample'),
    b AS (SELECT plate_id, median(od450) AS blank_median, CASE WHEN count(*) > 1 THEN {_SD} END AS blank_sd, count(*) AS nb FROM x WHERE role <> 'sample' GROUP BY 1),
    f AS (SELECT plate_id, CAST(sum(CAST(od450 AS DECIMAL(16,9))) AS DOUBLE) / count(*) AS mean, {_SD} AS sd, min(od450) AS min, max(od450) AS max, median(od450) AS median, median(abs(od450 - med)) AS mad, quantile_cont(od450, 0.75) - quantile_cont(od450, 0.25) AS iqr,
          quantile_cont(od450, 0.9) AS p90, quantile_cont(od450, 0.99) AS p99, avg(od450) FILTER (r <= greatest(1, n // 10)) AS top, skewness(od450) AS skew, kurtosis(od450) AS kurtosis, avg((od450 > 1)::INT) AS f1, avg((od450 > 2)::INT) AS f2, avg((od450 > 3.6)::INT) AS fc, avg((od450 < 0.15)::INT) AS fb, count(*)::DOUBLE AS n FROM s GROUP BY 1)
    SELECT plate_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / mean, 6) AS cv, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr, round(p90 / median, 6) AS p90_over_median, round(p99 / median, 6) AS p99_over_median,
           round(top, 6) AS top_decile_mean, round(top / median, 6) AS top_over_median, round(coalesce(skew, 0), 6) AS skew, round(coalesce(kurtosis, 0), 6) AS kurtosis, round(f1, 6) AS frac_over_1, round(f2, 6) AS frac_over_2, round(fc, 6) AS frac_near_ceiling, round(fb, 6) AS frac_near_blank, round((max - min) / median, 6) AS range_over_median,
           n AS n_samples, round(n / (n + coalesce(nb, 0)), 6) AS fill_fraction, round(blank_median, 6) AS blank_median, round(blank_sd, 6) AS blank_sd, round(median / blank_median, 6) AS signal_over_blank, round(top / blank_median, 6) AS top_over_blank
    FROM f LEFT JOIN b USING (plate_id)
""")
def plate_features(spark, sf):
    out = plates.plate_features(_values(spark, sf))
    return out.select("plate_id", *[_R6(c).alias(c) for c in plates.FEATURES])


@query(f"SELECT plate_id, well, od450, CASE WHEN row_number() OVER (PARTITION BY plate_id ORDER BY od450 DESC, well) <= 40 + plate_id THEN 'sample' ELSE 'empty' END AS role FROM ({_VALUES})")
def infer_roles(spark, sf):
    return plates.infer_roles(_values(spark, sf).drop("role"), 40 + F.col("plate_id"))


@query(f"""
    WITH w AS (SELECT p + 1 AS down, concat(chr(CAST(65 + p % 8 AS INT)), lpad(CAST(1 + p // 8 AS VARCHAR), 2, '0')) AS well FROM range(96) t(p)),
    f AS (SELECT well, row_number() OVER (ORDER BY down) AS n FROM w WHERE well NOT IN ('A01', 'H12')), c AS (SELECT *, row_number() OVER (ORDER BY md5(p_name), p_partkey) AS n FROM (SELECT p_partkey, p_name FROM part ORDER BY md5(p_name), p_partkey LIMIT 90))
    SELECT p_partkey, p_name, well FROM c JOIN f USING (n)
""")
def plate_layout(spark, sf):
    """Ninety clones in fill order around two reserved wells."""
    clones = d.table(spark, sf, "part").select("p_partkey", "p_name").orderBy(F.md5("p_name"), "p_partkey").limit(90)
    return plates.to_plate(clones, [F.md5("p_name"), F.col("p_partkey")], reserved=("A01", "H12"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, sf):
    rows = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return plates.latest(rows, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(f"""
    SELECT pair_id, bool_and((a.c = 'true') IS NOT DISTINCT FROM (b.c = 'true')) AS matches FROM (SELECT pair_id, well, CAST(od450_target IS NOT NULL AS VARCHAR) AS c FROM ({d.CELLS_SQL})) a FULL JOIN (SELECT pair_id, well, CAST(od450_control IS NOT NULL AS VARCHAR) AS c FROM ({d.CELLS_SQL})) b USING (pair_id, well) GROUP BY 1
""")
def layout_matches(spark, sf):
    """Both plates of every pair."""
    c = d.cells(spark, sf)
    side = lambda n: c.select("pair_id", "well", F.col(f"od450_{n}").isNotNull().cast("string").alias("clone_id"))
    return plates.layout_matches(side("target"), side("control"), ["pair_id"])


@query("""
    WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS plate_id, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS have FROM lineitem),
    n AS (SELECT *, 1000 / have AS need FROM c)
    SELECT plate_id, l_linenumber, l_partkey, l_suppkey, l_quantity, have AS concentration, CASE WHEN have IS NOT NULL THEN round_even(least(greatest(need, 2), 100), 2) END AS sample_ul, CASE WHEN have IS NOT NULL THEN round_even(100 - least(greatest(need, 2), 100), 2) END AS diluent_ul,
           round(CASE WHEN have IS NULL THEN NULL WHEN need < 2 THEN have * 2 / 100 ELSE least(10, have * least(greatest(need, 2), 100) / 100) END, 6) AS final_conc,
           CASE WHEN have IS NULL THEN 'unmeasured' WHEN need > 100 THEN 'too dilute' WHEN need < 2 THEN 'below minimum transfer' ELSE '' END AS flag FROM n
""")
def normalise_plan(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("plate_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("well"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice") / 1000).alias("concentration"))
    return plates.normalise_plan(rows).select("plate_id", "well.*", "concentration", "sample_ul", "diluent_ul", "final_conc", "flag")


@query("""
    SELECT event_id, round(0.05 + 3.95 * (1 - exp(-0.055 * greatest(value - 50, 0) / 100 * 15)), 9) AS od FROM events
""")
def optical_density(spark, sf):
    return d.table(spark, sf, "events").select("event_id", F.round(plates.optical_density((F.col("value") - 50) / 100), 9).alias("od"))


@query("""
    WITH RECURSIVE a(obj_id, up, depth) AS (SELECT o_orderkey, o_orderkey // 2, 1 FROM orders WHERE o_orderkey <> 0 AND o_orderkey // 2 IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT obj_id, up // 2, depth + 1 FROM a WHERE up <> 0 AND up // 2 IN (SELECT o_orderkey FROM orders))
    SELECT obj_id, min(up) AS root, CAST(max(depth) AS BIGINT) AS depth FROM a GROUP BY 1 UNION ALL SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey = 0 OR o_orderkey // 2 NOT IN (SELECT o_orderkey FROM orders)
""")
def artifact_lineage(spark, sf):
    """The root of every artifact of a forest and its depth."""
    rows = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obj_id"), F.floor(F.col("o_orderkey") / 2).alias("parent_id"))
    return ledger.doubled_ancestors(rows)


@query("""
    WITH RECURSIVE w AS (SELECT DISTINCT l_orderkey % 200 AS plate, l_partkey % 8 AS well, l_orderkey % 200 // 3 AS up, l_partkey % 8 // 2 AS up_well FROM lineitem WHERE l_orderkey % 200 >= 3),
    t(start_plate, start_well, plate_id, well, depth) AS (SELECT DISTINCT l_orderkey % 200, l_partkey % 8, l_orderkey % 200, l_partkey % 8, 0 FROM lineitem
        UNION ALL SELECT t.start_plate, t.start_well, w.up, w.up_well, t.depth + 1 FROM t JOIN w ON t.plate_id = w.plate AND t.well = w.well)
    SELECT * FROM t
""")
def well_trace(spark, sf):
    """Ancestors of all wells through the levels of plates."""
    rows = d.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("plate_id"), (F.col("l_partkey") % 8).alias("well")).distinct()
    stored = rows.withColumns({"source_plate_id": F.when(F.col("plate_id") >= 3, F.floor(F.col("plate_id") / 3)), "source_well": F.floor(F.col("well") / 2)})
    return plates.trace_wells(stored, rows).select("start_plate", "start_well", "plate_id", "well", "depth")


@query("SELECT o_orderkey AS obj_id, o_orderstatus AS obj_type FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey // 2 FROM orders WHERE o_orderpriority = '1-URGENT')")
def current_artifacts(spark, sf):
    o = d.table(spark, sf, "orders")
    links = o.where("o_orderpriority = '1-URGENT'").select(F.floor(F.col("o_orderkey") / 2).alias("parent_id"), F.col("o_orderkey").alias("child_id"), F.lit("superseded_by").alias("relationship"))
    return ledger.current(o.select(F.col("o_orderkey").alias("obj_id"), F.col("o_orderstatus").alias("obj_type")), links)


@query("SELECT event_id AS obj_id, event_type AS obj_type FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'purchase'")
def meta_find(spark, sf):
    e = d.table(spark, sf, "events").select(F.col("event_id").alias("obj_id"), F.col("event_type").alias("obj_type"), F.col("props").alias("meta_json"))
    return ledger.find(e, "purchase", k=7).select("obj_id", "obj_type")


@query("SELECT event_id AS run_id, event_type AS step_type FROM events WHERE event_id % 7 = 3 OR user_id % 50 = 3")
def step_history(spark, sf):
    e = d.table(spark, sf, "events")
    ids = lambda *c: F.to_json(F.array(*[F.concat(F.lit("PLT-"), x.cast("string")) for x in c]))
    steps = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("step_type"), ids(F.col("event_id") % 7).alias("inputs_json"), ids(F.col("user_id") % 50, F.lit(99)).alias("outputs_json"))
    return ledger.step_history(steps, "PLT-3").select("run_id", "step_type")


@query("""
    SELECT event_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'planned' END AS status, CASE WHEN event_type = 'error' THEN 'x' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_type = 'error' THEN '1' END AS seen FROM events
""")
def step_record(spark, sf):
    e = d.table(spark, sf, "events")
    steps = e.select(F.col("event_id").alias("run_id"), F.lit("planned").alias("status"), F.lit(None).cast("string").alias("finished_at"), F.col("props").alias("meta_json"))
    done = e.where("event_type = 'error'").select(F.col("event_id").alias("run_id"), F.lit("failed").alias("status"), F.lit("2020").alias("finished_at"), F.lit('{"k":"x","seen":"1"}').alias("observed"))
    return ledger.record(steps, done).select("run_id", "status", F.get_json_object("meta_json", "$.k").alias("k"), F.get_json_object("meta_json", "$.seen").alias("seen"))


_GRIDS = "SELECT page_id AS grid_id, lower(concat(url, ' ', html)) AS t FROM pages"
_SAYS_TARGET = "regexp_matches(t, 'target|antigen|experimental|test|expt')"
_SAYS_CONTROL = "regexp_matches(t, 'control|ctrl|hla|irrelevant|negative|neg')"
#: One code in five is on two plates.
_CODES = "SELECT concat('/', CAST(n_nationkey AS VARCHAR)) AS barcode, concat('PLT-', n_nationkey) AS plate_id FROM nation UNION ALL SELECT concat('/', CAST(n_nationkey AS VARCHAR)), concat('PLT-', n_nationkey, 'b') FROM nation WHERE n_nationkey % 5 = 0"
_WORDS = "SELECT DISTINCT source AS name, concat('PLT-', source) AS plate_id FROM documents WHERE length(source) > 3"


@query(f"""
    WITH g AS ({_GRIDS}), b AS (SELECT grid_id, greatest(count(DISTINCT barcode), count(DISTINCT plate_id)) AS n, min(plate_id) AS plate_id FROM g JOIN ({_CODES}) ON contains(t, lower(barcode)) GROUP BY 1),
    m AS (SELECT grid_id, min(plate_id) AS plate_id FROM g JOIN ({_WORDS}) ON contains(t, lower(name)) GROUP BY 1 HAVING count(DISTINCT name) = 1)
    SELECT g.grid_id, CASE WHEN b.n = 1 THEN 'barcode' WHEN m.plate_id IS NOT NULL THEN 'name' ELSE 'unresolved' END AS source, CASE WHEN b.n = 1 THEN b.plate_id ELSE m.plate_id END AS plate_id,
           CAST(CASE WHEN b.n = 1 THEN 0.99 WHEN m.plate_id IS NOT NULL THEN 0.8 ELSE 0.0 END AS DOUBLE) AS confidence,
           CASE WHEN {_SAYS_TARGET} AND NOT {_SAYS_CONTROL} THEN 'target' WHEN {_SAYS_CONTROL} AND NOT {_SAYS_TARGET} THEN 'control' END AS plate_kind
    FROM g LEFT JOIN b USING (grid_id) LEFT JOIN m USING (grid_id)
""")
def assign_propose(spark, sf):
    grids = d.table(spark, sf, "pages").select(F.col("page_id").alias("grid_id"), F.concat("url", F.lit(" "), "html").alias("text"))
    codes = d.table(spark, sf, "nation").select(F.concat(F.lit("/"), F.col("n_nationkey").cast("string")).alias("barcode"), F.concat(F.lit("PLT-"), F.col("n_nationkey").cast("string")).alias("plate_id"))
    codes = codes.unionByName(codes.where(F.substring("barcode", 2, 9).cast("int") % 5 == 0).withColumn("plate_id", F.concat("plate_id", F.lit("b"))))
    names = d.table(spark, sf, "documents").select(F.col("source").alias("name"), F.concat(F.lit("PLT-"), F.col("source")).alias("plate_id")).distinct()
    return assign.propose(grids, codes, names)


@query("SELECT CAST(place // 2 AS BIGINT) AS pair, max(c_custkey) FILTER (place % 2 = 0) AS first, max(c_custkey) FILTER (place % 2 = 1) AS second FROM (SELECT c_custkey, c_custkey AS place FROM customer) GROUP BY 1")
def pair_up(spark, sf):
    return assign.pair_up(d.table(spark, sf, "customer").select(F.col("c_custkey").alias("grid_id"), F.col("c_custkey").alias("place")))


@query("""
    SELECT line, count(*) AS n FROM (
        SELECT unnest([concat('A;Source;;;', l_partkey % 96 + 1, ';;', printf('%.2f', l_quantity), ';;;;'), concat('D;Destination;;;', l_suppkey % 96 + 1, ';;', printf('%.2f', l_quantity), ';;;;'), 'W1;']) AS line FROM lineitem) GROUP BY 1
""")
def tecan_worklist(spark, sf):
    return worklists.emit(d.transfers(spark, sf), "tecan_evo", allow_unverified=True).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above, min(l_quantity) AS min_ul, max(l_quantity) AS max_ul FROM lineitem")
def volume_check(spark, sf):
    return worklists.check_volumes(d.transfers(spark, sf), 5, 45)


_SAMPLES = "SELECT s_suppkey AS p, s_name FROM supplier WHERE s_suppkey < 60"
_W = "concat(chr(CAST(65 + {p} % 8 AS INT)), lpad(CAST(1 + {p} // 8 AS VARCHAR), 2, '0'))"


def _samples(spark, sf):
    """Sixty samples down the plate."""
    s = d.table(spark, sf, "supplier").where("s_suppkey < 60")
    return s.select(wells.at_column_major(F.col("s_suppkey") + 1).alias("well"), F.col("s_name").alias("sample_name"))


@query(f"""
    SELECT concat(chr(CAST(65 + p // 12 AS INT)), lpad(CAST(1 + p % 12 AS VARCHAR), 2, '0')) AS "Well (H)", {_W.format(p="p")} AS "Well (V)", p + 1 AS "Sample #", s_name AS "DNA Name", '' AS "Length (bp)", '' AS "Concentration (ng/uL)", 'M13F' AS "Primer",
           '' AS "Difficult Template", '' AS "Notes", '' AS "Is Empty" FROM ({_SAMPLES})
""")
def form_genewiz(spark, sf):
    return forms.order(_samples(spark, sf), "genewiz", primer="M13F")


@query(f"""
    SELECT row_number() OVER (ORDER BY p % 8, p // 8) AS "Reaction #", concat(chr(CAST(65 + p % 8 AS INT)), 1 + p // 8) AS "Well", s_name AS "Template Name*", 'Plasmid' AS "Template Type", '' AS "Template Conc (ng/ul)", '' AS "Template Size (bp)*", 'M13F' AS "Primer Name*",
           '' AS "Primer Conc (uM)", 'Premix' AS "Premix?*", '' AS "Preferred Annealling Temp. (oC)", 'No' AS "GC Rich?", '' AS "Notes" FROM (SELECT p, replace(s_name, '#', '_') AS s_name FROM ({_SAMPLES}))
""")
def form_elim(spark, sf):
    return forms.order(_samples(spark, sf).withColumn("sample_name", F.translate("sample_name", "#", "_")), "elim", primer="M13F")


@query(f"""
    WITH w AS (SELECT p, concat(chr(CAST(65 + p % 8 AS INT)), 1 + p // 8) AS well, coalesce(s_name, '') AS name FROM range(96) t(p) LEFT JOIN ({_SAMPLES}) USING (p))
    SELECT a.well AS "well #", a.name AS "SAMPLE NAME", '' AS "SPECIAL INSTRUCTION", b.well AS "well # (7-12)", b.name AS "SAMPLE NAME (7-12)", '' AS "SPECIAL INSTRUCTION (7-12)" FROM w a JOIN w b ON a.p + 48 = b.p
""")
def form_ucberkeley(spark, sf):
    return forms.order(_samples(spark, sf), "ucberkeley")


@query()
def plate_classifier(spark, sf):
    """Target or control by the shape of a plate: gradient-boosted trees, plates of one pair in one fold."""
    from ..operators import classify

    c = d.cells(spark, sf)
    sides = [c.where(f"od450_{n} IS NOT NULL").select(F.concat_ws("-", F.col("pair_id").cast("string"), F.lit(n)).alias("plate_id"), "pair_id", F.lit(label).alias("label"), "well", F.col(f"od450_{n}").alias("od450"), F.lit("sample").alias("role")) for n, label in (("target", 1.0), ("control", 0.0))]
    values = sides[0].unionByName(sides[1])
    features = plates.plate_features(values).join(values.select("plate_id", "pair_id", "label").distinct(), "plate_id")
    return classify.out_of_fold(features, plates.FEATURES, "pair_id").select("plate_id", "label", "prediction")


@query()
def caller_evaluation(spark, sf):
    """Every caller on 600 simulated pairs with a known truth, uncallable plates refused."""
    from ..operators import simulate

    made = checkpointed(simulate.simulate_pairs(spark, 600))
    samples = made.where("role = 'sample'").select("pair_id", "well", "od450_target", "od450_control", "is_binder")
    empty = made.where("role <> 'sample'").select("pair_id", "well", F.col("od450_target").alias("od450"))
    return hits.summarise(hits.evaluate(samples, samples, empty))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def windowed_readings(spark, sf):
    from ..streaming import counts_by_window

    return counts_by_window(d.table(spark, sf, "events"))

