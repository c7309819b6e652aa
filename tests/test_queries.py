"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparkwell.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in SQL:
        assert got
        return
    answer = duck.sql(SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


def test_germline_queries_see_the_whole_pool(spark):
    """Rows, genes and residues beyond any sample or prefix; the rows of an alignment are the first by loop length and id."""
    from pyspark.sql import functions as F

    from sparkwell.plans import derive

    pool = [(r["v_gene"], r["cdr3_len"], r["seq_id"], r["aa_seq"]) for r in derive.pool(spark, SF).select("v_gene", "cdr3_len", "seq_id", "aa_seq").collect()]
    shown = {s: a for g in {p[0] for p in pool} for _, _, s, a in sorted(p for p in pool if p[0] == g)[:50] if a.strip()}
    aligned = QUERIES["align_to_germline"](spark, SF).collect()
    assert {r["seq_id"]: r["gapped"].replace("-", "") for r in aligned} == shown
    first = {g: min((s, a) for h, _, s, a in pool if h == g and a.strip()) for g in {p[0] for p in pool}}
    seen = QUERIES["germline_differences"](spark, SF).groupBy("seq_id").agg(F.max("number").alias("n")).collect()
    own = {s for s, _ in first.values()}
    assert {r["seq_id"] for r in seen} >= {s for g, _, s, a in pool if s not in own and a not in first[g][1]} - own
    assert max(r["n"] for r in seen) > 60
