"""What happens beyond the sizes that are broadcast, and that nothing is left over."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sparkwell.llm import exact_dedup, near_dedup, pii, quality, shared, warc


def test_bitmap_has_no_false_negatives(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("body")).unionByName(spark.createDataFrame([(None, "x")], "k long, body string"))
    keys = spark.range(0, 20_000, 7).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    hit = {r["k"] for r in shared.perhaps_in(rows, keys, [F.col("k")], ["k"], "hit").where("hit").collect()}
    sure = {*range(0, 20_000, 7), None}
    assert sure <= hit and len(hit) < len(sure) + 20
    assert shared.perhaps_in(rows, keys.limit(0), [F.col("k")], ["k"], "hit").where("hit").count() == 0


@pytest.fixture
def nothing_small(monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)


def collected(frame):
    return sorted(map(str, frame.collect()))


def test_dedup_beyond_broadcasts(odd, monkeypatch):
    want = [collected(f(odd)) for f in (exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates)]
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert [collected(f(odd)) for f in (exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates)] == want


def test_archives_beyond_broadcasts(spark, nothing_small):
    pages = spark.createDataFrame([(i, "u", ("a" if i % 3 else f"b{i}") * 2000) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    assert got == {i: ("revisit", 29) if i % 3 and i != 29 else ("response", None) for i in range(30)}


def test_only_candidates_are_shuffled(spark, nothing_small, monkeypatch):
    """Payloads that are not repeated are read, written, and never exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "k long, body string").repartition(4)
        keys = shared.materialize(docs.where("k < 3").select("k", F.lit(1).cast("long").alias("n")), "keys")
        joined = shared.matching(shared.materialize(docs, "rows"), keys, "k", 100)
        assert joined.count() == 3
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        before = plan[plan.index("Join LeftOuter, (k#") :] if "Join LeftOuter, (k#" in plan else plan
        assert "_bits" in plan and before.count("Filter") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_goes_when_closed(spark, odd):
    for make in (exact_dedup.exact_duplicates, near_dedup.near_duplicates):
        scratch = shared.Scratch(spark, "closed")
        assert make(odd, scratch=scratch).count() == odd.count()
        folder = spark._jvm.org.apache.hadoop.fs.Path(scratch.base)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        assert store.exists(folder)
        scratch.close()
        assert not store.exists(folder)


def test_names_of_any_case(spark):
    docs = spark.createDataFrame([(1, "mail me@example.com", 19), (2, None, None)], "doc_id long, Text string, N_Chars int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["Text"] for r in pii.redact_pii(docs).orderBy("doc_id").collect()] == ["mail [EMAIL]", None]
    assert quality.keep_quality(docs, labels).count() == 2


def test_every_passage_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", classmethod(lambda cls, bags, labels, weights, **k: seen.append((bags, labels, weights)) or cls.constant(0.5)))
    words = "word " * (64 * 300)
    docs = spark.createDataFrame([(i, words if i % 2 else "short text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.fit_quality(docs, labels)
    bags, y, weights = seen[0]
    assert {(len(b), t) for b, t in zip(bags, y.tolist(), strict=True)} == {(300, 1.0), (1, 0.0)}
    monkeypatch.setattr(quality, "TRAIN_BYTES", 3 * len(words) + 1)
    quality.fit_quality(docs, labels)
    bags, y, fewer = seen[1]
    assert sum(y == 1) == 3 and sum(y == 0) == sum(seen[0][1] == 0)
    # the three stand for all of their class
    assert fewer[y == 1].sum() / fewer[y == 0].sum() == pytest.approx(weights[seen[0][1] == 1].sum() / weights[seen[0][1] == 0].sum())


def test_account_numbers():
    auto = pii.anchors()
    spans = lambda t: [(k, t[a:b]) for k, a, b in pii.find_spans(t, auto) if k == "iban"]
    assert spans("IBAN: GB82 WEST 1234 5698 7654 32.") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert spans("iban de89370400440532013000 x") == [("iban", "de89370400440532013000")]
    assert spans("iban GB82WEST12345698765433") == spans("iban 12GB") == spans("iban GBX2WEST12345698765432") == spans("iban") == []
    began = time.perf_counter()
    pii.find_spans("iban GB82" * ((1 << 20) // 9), auto)
    assert time.perf_counter() - began < 8
