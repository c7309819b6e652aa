"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwell.llm import bagminhash as bag
from sparkwell.llm import near_dedup, shared
from sparkwell.llm.components import connected_components
from sparkwell.llm.exact_dedup import QuotientFilter, drop_exact_duplicates, exact_duplicates, repeated_fingerprints


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1), max_size=60), min_size=1, max_size=4), st.integers(20, 64))
def test_quotient_filters_merge_losslessly(groups, bits):
    filters = [QuotientFilter.from_row(QuotientFilter.build(np.array(g, np.uint64), bits=bits).to_row(), bits) for g in groups]
    keys, counts = QuotientFilter.merge(filters).items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(x for g in groups for x in g)
    assert keys.tolist() == sorted(keys.tolist())


def test_filter_with_clustered_quotients():
    keys = np.array([2**63 + i for i in range(100)] + [2**64 - 1] * 3 + [0], np.uint64)
    got, counts = QuotientFilter.build(keys).items()
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == Counter(keys.tolist())


def test_repeated_fingerprints(spark):
    rng = random.Random(1)
    data = [rng.choice([rng.randrange(-(2**63), 2**63), 7, -9]) for _ in range(3000)]
    frame = spark.createDataFrame([(x,) for x in data], "fp long").repartition(5)
    got = {r["fp"]: r["fp_count"] for r in repeated_fingerprints(frame, len(data)).collect()}
    assert got == {k: n for k, n in Counter(data).items() if n > 1}


def brute_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    best = {t: max((k for k in keys if k is not None), default=None) for t, keys in groups.items()}
    return Counter((k, best[t or ""] if len(groups[t or ""]) > 1 else k, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)


def test_exact(spark, odd, empty):
    out = exact_duplicates(odd)
    rows = out.collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == brute_exact([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert exact_duplicates(empty).count() == 0
    survivors = drop_exact_duplicates(odd)
    assert survivors.columns == odd.columns and survivors.count() == len(kept)


def test_exact_with_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 900}") for i in range(4000)]
    out = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == brute_exact(rows)


def test_without_broadcasts(spark, monkeypatch):
    """Beyond the bound on rows, the joins go by shuffle, hot keys apart; here every key of more than two rows is hot."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 300)
    monkeypatch.setattr(shared, "hot_threshold", lambda total: 2)
    rows = corpus(5, 12, 12) + [(10_000 + i, "the same words again and again " * 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = exact_duplicates(frame).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == brute_exact(rows)
    near = near_dedup.near_duplicates(frame).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near) == brute_near(rows)


# ---------------------------------------------------------------- near


def words(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", "".join(c.lower() if c < "Ā" else c for c in text))


def shingles(text):
    w = words(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_near(rows):
    """doc_id -> (class id, rows in the class)."""
    texts = list({t or "" for _, t in rows})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups, index = defaultdict(list), {t: i for i, t in enumerate(texts)}
    for key, t in rows:
        groups[find(index[t or ""])].append(key)
    return Counter((key, max((k for k in g if k is not None), default=None), len(g)) for g in groups.values() for key in g)


def multiset(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return bag.multisets(data, np.array([0, len(data)]))


@settings(max_examples=40, deadline=None)
@given(st.text("ab É_9ß.\n", max_size=80), st.text("ab É_9ß.\n", max_size=80))
def test_multisets(a, b):
    assert sorted(multiset(a)[2].tolist()) == sorted(shingles(a).values())
    assert bag.similarity(multiset(a)[1:], multiset(b)[1:]) == pytest.approx(jaccard(shingles(a), shingles(b)))


def unicode_shingles(text):
    w = [x.lower() for x in re.findall(r"\w+", text)]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


ODD_LETTERS = "ab É×÷_9ß.«»\u00a0“—ДдΣσς。、漢字ｱ́İ🙂½\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ODD_LETTERS, max_size=60), min_size=1, max_size=4))
def test_words_of_unicode(texts):
    """Texts within Latin-1's letters and others side by side."""
    raw = [t.encode() for t in texts]
    doc, _, n = bag.multisets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert sorted(n[doc == i].tolist()) == sorted(unicode_shingles(t).values())
        assert bag.similarity(multiset(t)[1:], multiset(texts[0])[1:]) == pytest.approx(jaccard(unicode_shingles(t), unicode_shingles(texts[0])))


def test_near_copies_beyond_latin(spark):
    """Copies that differ in quotes, dashes and spaces, in case, or in a character of one of many sentences."""
    prose = [f"word{i}" for i in range(40)]
    cyrillic, greek, chinese = ("слово дело мысль " * 20 + "конец").split(), ("λόγος ἔργον φως " * 20).split(), [chr(0x4E00 + 7 * i) * 3 for i in range(60)]
    pairs = [
        (" ".join(f'"{w}"' for w in prose), "\u00a0".join(f"“{w}”" for w in prose)),
        (" ".join(w + str(i) for i, w in enumerate(cyrillic)), " ".join(w.upper() + str(i) for i, w in enumerate(cyrillic))),
        (" ".join(w + str(i) for i, w in enumerate(greek)), " ".join(w.upper() + str(i) for i, w in enumerate(greek))),
        ("。".join(chinese), "。".join([*chinese[:30], "變", *chinese[31:]])),
    ]
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {k: k | 1 for k, _ in rows}


def test_signatures_are_unbiased():
    """Agreement of slots against weighted similarity, with weights above one, over many independent pairs."""
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(120):
        shingle = rng.integers(0, 2**44, 40).astype(np.uint64)
        a, b = rng.integers(1, 40, 40), rng.integers(1, 40, 40)
        sig = bag.signatures(np.repeat([0, 1], 40), np.r_[shingle, shingle], np.r_[a, b], 2)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(120 * bag.SLOTS)


def corpus(seed, groups, size):
    """Chains of edits: neighbours are alike, ends are not."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for _ in range(groups):
        text = rng.choices(vocabulary, k=rng.randrange(30, 120))
        for _ in range(rng.randrange(1, size)):
            rows.append((key, " ".join(text)))
            key += 1
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(3, 25, 30)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in out) == brute_near(rows)
    assert Counter(r["class_id"] for r in out if r["kept"]) == Counter({r["class_id"]: 1 for r in out})


def test_near_odd(spark, odd, empty):
    out = near_dedup.near_duplicates(odd)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in out.collect()) == brute_near([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == out.where("kept").count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (103, 103), (200, 201), (201, 200)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 103), 100), 200: 200, 201: 200, **dict.fromkeys(range(300, 340), 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
