"""Quality, language, personal data, sharding, the pipeline."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwell.llm import language, pii, quality, sharding
from sparkwell.llm.shared import materialize

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are absent")


# ---------------------------------------------------------------- personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


@settings(max_examples=800, deadline=None)
@given(st.text("0123456789 .-+@ab()é٣", max_size=60))
@example("a@b.c@d.e 4111 1111-1111 1111 1.2.3.4.5.6.7.8 +1 (555) 555-0100-")
def test_base_spans(text):
    assert [s for s in pii.find_spans(text, pii.anchors()) if s[0] in pii.BASE] == brute(text)


def test_more_spans():
    text = 'see https://a.example/x?y=1, IBAN GB82 WEST 1234 5698 7654 32; token = "24be64439e3e49cf46b2d7c90f3602a3" and token = short'
    found = {k: text[a:b] for k, a, b in pii.find_spans(text, pii.anchors())}
    assert found["url"] == "https://a.example/x?y=1" and found["iban"] == "GB82 WEST 1234 5698 7654 32" and found["secret"].startswith("24be")
    assert pii.redact("a b@c.de d", [("email", 2, 8)]) == "a [EMAIL] d"


def test_pii(odd, empty):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and sum(r["n_email"] for r in rows) == 1 and sum(r["n_phone"] for r in rows) == 1
    clean = pii.redact_pii(odd)
    assert clean.columns == odd.columns and "mail [EMAIL] or [PHONE]" in {r["text"] for r in clean.collect()}
    assert {r["n_chars"] for r in clean.where("text LIKE 'mail%'").collect()} == {len("mail [EMAIL] or [PHONE]")}
    assert Counter(r["text"] for r in clean.collect())[None] == 1
    assert pii.find_pii(empty).count() == pii.redact_pii(empty).count() == 0


# ---------------------------------------------------------------- shards


def test_shards(spark, odd, empty):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.assign_shards(docs, [1.0] * 24).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and all(abs(n - 5000 / 24) < 5 * (5000 / 24) ** 0.5 for n in sizes.values())
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 100 < len(moved) < 320
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.repartition(7), [1.0] * 25).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in rows)
    got = sharding.assign_shards(odd, [1.0, 2.0]).collect()
    assert len(got) == odd.count()
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in odd.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == texts
    assert sharding.assign_shards(empty, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(None, [])


def test_weights(spark):
    rows = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in rows}
    assert n[1] / 20_000 == pytest.approx(0.75, abs=0.02)


# ---------------------------------------------------------------- models


def test_gradient():
    rng = np.random.default_rng(2)
    x, first, y, w = rng.normal(size=(12, quality.FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])
    model = quality.AttentionModel.fit([rng.normal(size=(2, quality.FEATURES)).astype(np.float32) for _ in range(8)], np.array([0.0, 1] * 4), np.ones(8), steps=5)

    def loss():
        p = quality._sigmoid(model.forward(x, first)[-1])
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    for name, g in model.gradient(x, first, y, w).items():
        flat = model.p[name].reshape(-1)
        k = int(np.abs(g).argmax())
        old = flat[k]
        flat[k] = old + 1e-6
        up = loss()
        flat[k] = old - 1e-6
        down = loss()
        flat[k] = old
        assert (up - down) / 2e-6 == pytest.approx(g.reshape(-1)[k], rel=1e-3, abs=1e-8)
    weights = model.attention(x, first)
    assert np.add.reduceat(weights, first) == pytest.approx(np.ones(4))


def test_passages_do_not_depend_on_neighbours():
    texts = [b"", b"one two three", b"x " * 300, "é ü! ".encode() * 90, b" "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, first = quality.passage_features(data, offsets)
    for t, part in zip(texts, np.split(x, first[1:]), strict=True):
        alone, _ = quality.passage_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert part == pytest.approx(alone)


@tables
def test_quality_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    rows = quality.classify_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify_quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_quality(odd, labels).columns == odd.columns


@tables
def test_language_holds_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.96


def test_mixtures(spark):
    rng = random.Random(1)
    tongue = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["kraxu", "zwiqo", "vexty", "jupky"]}
    text = lambda k, n: " ".join(rng.choices(tongue[k], k=n))
    train = spark.createDataFrame([(k, text(k, 50)) for k in tongue for _ in range(10)] + [(None, "x"), ("aa", None)], "lang string, text string")
    model = language.fit_languages(train)
    docs = spark.createDataFrame([(1, text("aa", 30) + " " + text("bb", 70)), (2, text("aa", 40)), (3, "12 !?"), (4, None), (5, "—“”"), (6, "漢字")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 1), r["languages"]) for r in language.predict_languages(docs, model, ["doc_id"]).collect()}
    assert got[1] == ("bb", 0.7, ["bb", "aa"]) and got[2] == ("aa", 1.0, ["aa"])
    assert got[3] == got[4] == got[5] == ("und", 0.0, []) and got[6][0] in tongue


def test_mixtures_of_many(spark):
    """A text of every learned language tells all of them, with their shares."""
    rng = random.Random(2)
    tongue = {k: ["".join(rng.choices(letters, k=6)) for _ in range(8)] for k, letters in zip("abcde", ("abcde", "fghij", "klmno", "pqrst", "uvwxy"), strict=True)}
    text = lambda k, n: " ".join(rng.choices(tongue[k], k=n))
    model = language.fit_languages(spark.createDataFrame([(k, text(k, 50)) for k in tongue for _ in range(10)], "lang string, text string"))
    docs = spark.createDataFrame([(n, " ".join(text(k, 60 - 10 * i) for i, k in enumerate("edcba"[:n]))) for n in range(1, 6)], "doc_id long, text string")
    for r in language.predict_languages(docs, model, ["doc_id"]).collect():
        n = r["doc_id"]
        assert r["languages"] == list("edcba"[:n]) and abs(r["score"] - 60 / sum(60 - 10 * i for i in range(n))) < 0.02


def test_language_odd(odd, empty):
    rows = language.identify_languages(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert language.identify_languages(empty).count() == 0


# ---------------------------------------------------------------- pipeline


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert docs.select("text").distinct().count() == docs.count()
    assert pii.find_pii(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
