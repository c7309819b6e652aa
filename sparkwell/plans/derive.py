"""Domain inputs derived from the common tables: the same rows as a Spark frame and as SQL.

The tables hold orders, events and texts rather than repertoires and plates; each
derivation is a rule over their columns, stated twice, so that an operator can be
run on them and compared with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread

GENES = ("IGHV3-23", "IGHV1-69", "IGHV3-53", "IGHV4-34", "IGHV1-2", "IGKV1-39")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for queries that work long on each text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def protein(text: str = "text") -> F.Column:
    """The twenty residues among the ASCII letters of a text, in capitals."""
    return F.upper(F.regexp_replace(text, "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]+", ""))


def bases(text: str = "text") -> F.Column:
    """ASCII letters of a text mapped to bases."""
    return F.upper(F.translate(F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"))


DNA_SQL = "upper(translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'))"

_V_CALL = "concat(g[1 + doc_id % 6], '*0', 1 + doc_id % 3, CASE WHEN doc_id % 7 = 0 THEN concat(',', g[1 + (doc_id + 1) % 6], '*01') ELSE '' END)"
_STATUS = "CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'fw1 is shorter than IMGT defined' WHEN 3 THEN ' Deletions: 10, 73 | ' WHEN 4 THEN 'Missing Conserved Cysteine: 23' WHEN 5 THEN 'Shorter than IMGT defined|Missing Conserved Cysteine: 104' WHEN 6 THEN 'Insertion: 85A' ELSE '||' END"
_PRODUCTIVE = "CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'F' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN ' true ' WHEN 4 THEN 'no' ELSE 'T' END"

#: One row a document: id, calls, residues, loop, status, productive, reads.
REPERTOIRE_SQL = f"""
    SELECT doc_id, source AS source_ref, {_V_CALL} AS v_call, concat('IGHJ', 1 + doc_id % 6, '*01') AS j_call,
           concat(aa, CASE WHEN doc_id % 9 = 0 THEN 'XX' ELSE '' END) AS aa_seq,
           substr(aa, CAST(1 + doc_id % 50 AS INT), CAST(8 + doc_id % 23 AS INT)) AS cdr3_aa,
           {_STATUS} AS anarci_status, {_PRODUCTIVE} AS productive,
           CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 5 END AS redundancy
    FROM (SELECT doc_id, source, [{", ".join(f"'{x}'" for x in GENES)}] AS g,
                 regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS aa FROM documents)
"""


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "source", F.array(*map(F.lit, GENES)).alias("g"), protein().alias("aa"))
    spark_sql = lambda s: s.replace("g[1 + doc_id % 6]", "g[CAST(doc_id % 6 AS INT)]").replace("g[1 + (doc_id + 1) % 6]", "g[CAST((doc_id + 1) % 6 AS INT)]")
    return docs.selectExpr(
        "doc_id", "source AS source_ref", f"{spark_sql(_V_CALL)} AS v_call", "concat('IGHJ', 1 + doc_id % 6, '*01') AS j_call",
        "concat(aa, CASE WHEN doc_id % 9 = 0 THEN 'XX' ELSE '' END) AS aa_seq",
        "substr(aa, CAST(1 + doc_id % 50 AS INT), CAST(8 + doc_id % 23 AS INT)) AS cdr3_aa",
        f"{_STATUS} AS anarci_status", f"{_PRODUCTIVE} AS productive", "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 5 END AS redundancy",
    )


#: The repertoire in the pool's terms.
POOL_SQL = f"""
    SELECT *, concat('SEQ-', doc_id) AS seq_id, split_part(split_part(v_call, ',', 1), '*', 1) AS v_gene,
           nullif(regexp_extract(v_call, '^(IG[HKL][VDJ][0-9]+)', 1), '') AS v_family, CASE WHEN substr(v_call, 3, 1) = 'H' THEN 'H' ELSE 'L' END AS chain,
           CAST(length(cdr3_aa) AS BIGINT) AS cdr3_len, CAST(length(regexp_replace(aa_seq, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) AS BIGINT) AS n_ambiguous,
           len(list_filter(list_transform(string_split(coalesce(anarci_status, ''), '|'), lambda x: trim(x)),
               lambda x: x <> '' AND NOT contains(lower(x), 'shorter than imgt defined') AND NOT contains(lower(x), 'deletions:'))) > 0 AS has_liability
    FROM ({REPERTOIRE_SQL})
"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import germline as g

    call = F.col("v_call")
    return repertoire(spark, sf_dir).withColumns({
        "seq_id": F.concat(F.lit("SEQ-"), F.col("doc_id").cast("string")), "v_gene": g.gene(call), "v_family": g.family(call), "chain": g.chain_of(call),
        "cdr3_len": F.length("cdr3_aa").cast("long"), "n_ambiguous": g.ambiguous_residues(F.col("aa_seq")).cast("long"), "has_liability": g.has_liability(F.col("anarci_status")),
    })


#: Readings of both plates of each pair by well; one cell is the mean over its events.
#: Sums are of decimals, so that the order of events cannot matter.
_OD = "round(CAST(sum(CASE WHEN event_type = '{0}' THEN CAST(0.05 + 3.95 * (1 - exp(-0.01 * value)) AS DECIMAL(18,12)) END) AS DOUBLE) / count(*) FILTER (event_type = '{0}' AND value IS NOT NULL), 6)"
CELLS_SQL = f"""
    SELECT user_id % 10 AS pair_id, event_id % 96 AS place, concat(chr(CAST(65 + (event_id % 96) % 8 AS INT)), lpad(CAST(1 + (event_id % 96) // 8 AS VARCHAR), 2, '0')) AS well,
           {_OD.format("click")} AS od450_target, {_OD.format("view")} AS od450_control, {_OD.format("error")} AS od450_blank
    FROM events GROUP BY ALL
"""
PAIRS_SQL = f"SELECT pair_id, well, od450_target, od450_control FROM ({CELLS_SQL}) WHERE od450_target IS NOT NULL AND od450_control IS NOT NULL"
#: Blank readings: the fourth power of a reading over 64, so that they lie below signals.
BLANKS_SQL = f"SELECT pair_id, well, round(power(od450_blank, 4) / 64 + 0.02, 6) AS od450 FROM ({CELLS_SQL}) WHERE od450_blank IS NOT NULL AND place >= 84 AND pair_id % 2 = 0"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("event_id") % 96
    well = F.concat(F.char((65 + place % 8).cast("int")), F.lpad((F.floor(place / 8) + 1).cast("string"), 2, "0"))
    od = 0.05 + 3.95 * (1 - F.exp(-0.01 * F.col("value")))
    of = lambda kind: F.when(F.col("event_type") == kind, od.cast("decimal(18,12)"))
    mean = lambda kind: F.round(F.sum(of(kind)).cast("double") / F.nullif(F.count(of(kind)), F.lit(0)), 6)
    keys = table(spark, sf_dir, "events").withColumns({"pair_id": F.col("user_id") % 10, "place": place, "well": well})
    return keys.groupBy("pair_id", "place", "well").agg(mean("click").alias("od450_target"), mean("view").alias("od450_control"), mean("error").alias("od450_blank"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("od450_target IS NOT NULL AND od450_control IS NOT NULL").select("pair_id", "well", "od450_target", "od450_control")


def blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).where("od450_blank IS NOT NULL AND place >= 84 AND pair_id % 2 = 0")
    return rows.select("pair_id", "well", F.round(F.pow("od450_blank", F.lit(4)) / 64 + 0.02, 6).alias("od450"))


#: Transfers between wells, one a line item; the ordinal orders whole rows.
TRANSFERS_SQL = """
    SELECT l_orderkey AS source_plate_id, l_partkey % 96 AS s, l_suppkey % 96 AS d, l_quantity AS volume_ul, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import wells

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("volume_ul"))
    return rows.withColumns({"source_well": wells.at_column_major(F.col("l_partkey") % 96 + 1), "dest_well": wells.at_column_major(F.col("l_suppkey") % 96 + 1), "ordinal": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "volume_ul")})
