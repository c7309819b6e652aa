"""Clustered tables: what a fetch reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwell.operators import store


def scanned(frame):
    """Rows that the scans of a frame gave out, by the plan's own metrics, once it has run."""
    frame.collect()
    nodes, total = [frame._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pool") / "table")
    rows = spark.range(1_000_000).select(F.concat(F.lit("SEQ-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("seq_id"), (F.col("id") % 97).alias("v"), F.md5(F.col("id").cast("string")).alias("digest"))
    store.append_clustered(rows, path, "seq_id", files=8, row_group_bytes=1 << 20)
    return path, rows


def test_a_few_ids_read_little(spark, pool):
    path, rows = pool
    near = spark.range(500_000, 500_100).select(F.concat(F.lit("SEQ-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("seq_id"))
    found = store.fetch(spark, path, near, "seq_id")
    assert found.count() == 100 and sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.where("id BETWEEN 500000 AND 500099").collect()))
    assert scanned(store.fetch(spark, path, near, "seq_id")) < 100_000
    spread = spark.range(0, 1_000_000, 100_000).select(F.concat(F.lit("SEQ-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("seq_id"))
    assert scanned(store.fetch(spark, path, spread, "seq_id")) < 400_000
    absent = spark.createDataFrame([(f"SEQ-{i:09}x",) for i in range(100)], "seq_id string")
    assert store.fetch(spark, path, absent, "seq_id").count() == 0


def test_any_list_of_ids(spark, pool, monkeypatch):
    path, _ = pool
    ids = spark.createDataFrame([("SEQ-000000007",), ("SEQ-000000007",), ("none",), (None,)], "seq_id string")
    want = [("SEQ-000000007", 7)]
    assert [tuple(r) for r in store.fetch(spark, path, ids, "seq_id", ["seq_id", "v"]).collect()] == want
    monkeypatch.setattr(store, "PUSHED_IDS", 1)
    assert [tuple(r) for r in store.fetch(spark, path, ids, "seq_id", ["seq_id", "v"]).collect()] == want
    assert store.fetch(spark, path, ids.limit(0), "seq_id").count() == 0
