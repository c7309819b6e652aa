"""Edit-distance joins, core-sets, quantiles, trimming, exact deviations, barcodes on two plates."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.kernels import greedy, trim
from sparkwell.operators import assign, plates, quantiles, selection, sequencing, similar

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def loops(n, seed, letters=RESIDUES, low=0, high=24, near=0.3):
    rng = random.Random(seed)
    out: list[str] = []
    while len(out) < n:
        if out and rng.random() < near:
            s = list(rng.choice(out))
            for _ in range(rng.randint(1, 4)):
                at = rng.randint(0, len(s))
                kind = rng.random()
                if kind < 0.4 and at < len(s):
                    s[at] = rng.choice(letters)
                elif kind < 0.7:
                    s.insert(at, rng.choice(letters))
                elif at < len(s):
                    del s[at]
            out.append("".join(s))
        else:
            out.append("".join(rng.choice(letters) for _ in range(rng.randint(low, high))))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("letters", "edits"), [(RESIDUES, 1), (RESIDUES, 3), ("AG", 2), ("AG", 5)])
def test_pairs_within_edits(spark, letters, edits):
    seqs = sorted(set(loops(160, 3, letters, 0, 14)))
    rows = [(i, s, 1) for i, s in enumerate(seqs)] + [(None, "ACD", 1), (900, None, 1)]
    got = {(r["a"], r["b"], r["distance"]) for r in similar.within_edits(spark.createDataFrame(rows, "seq_id int, cdr3_aa string, piece int"), edits).collect()}
    want = {(i, j, d) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if (d := distance(seqs[i], seqs[j])) <= edits}
    assert got == want and want
    grouped = spark.createDataFrame([(i, s, i % 3) for i, s in enumerate(seqs)], "seq_id int, cdr3_aa string, g int")
    assert {(r["a"], r["b"], r["distance"]) for r in similar.within_edits(grouped, edits, group="g").collect()} == {w for w in want if w[0] % 3 == w[1] % 3}


def test_all_pairs_of_two_thousand(spark):
    seqs = sorted(set(loops(2000, 8, low=8)))
    frame = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, cdr3_aa string")
    got = sorted((r["a"], r["b"], r["distance"]) for r in similar.within_edits(frame, 2).collect())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (i INT, s VARCHAR)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(seqs)))
    want = sorted(duck.sql("SELECT x.i, y.i, levenshtein(x.s, y.s) FROM t x JOIN t y ON x.i < y.i AND abs(length(x.s) - length(y.s)) <= 2 WHERE levenshtein(x.s, y.s) <= 2").fetchall())
    assert got == want and len(want) > 50


@pytest.mark.parametrize("seqs", [loops(90, 1), loops(40, 2, "AG", 3, 9), ["AAAA", "CCCCCC"], ["", "A"], ["AC"], ["B", "B", "B"], ["", ""], []])
def test_worst_pairs(spark, seqs):
    frame = spark.createDataFrame([(f"s{i:03}", s, 0) for i, s in enumerate(seqs)], "seq_id string, cdr3_aa string, g int")
    alike = lambda a, b: 1.0 if not a and not b else round(1 - distance(a, b) / max(len(a), len(b)), 9)
    ranked = sorted((-alike(seqs[i], seqs[j]), f"s{i:03}", f"s{j:03}") for i in range(len(seqs)) for j in range(i + 1, len(seqs)))
    got = [(r["a"], r["b"], r["identity"]) for r in selection.worst_pair(frame).collect()]
    assert got == [(a, b, -x + 0.0) for x, a, b in ranked[:1]]


def test_identity_curve(spark):
    pool = spark.createDataFrame([(f"s{i:04}", s) for i, s in enumerate(loops(300, 5, low=8, near=0.6))], "seq_id string, cdr3_aa string")
    picked = pool.where("seq_id < 's0012'")
    curve = {r["draw"]: r["identity"] for r in similar.identity_curve(pool, picked, draws=4).collect()}
    assert set(curve) == set(range(5)) and curve[0] == selection.worst_pair(picked).first()["identity"]
    assert curve == {r["draw"]: r["identity"] for r in similar.identity_curve(pool.repartition(7), picked, draws=4).collect()}


# ---------------------------------------------------------------- core-sets


def radius(points, picks):
    return max(min(1 - (1 - distance(p, q) / max(len(p), len(q), 1)) for q in picks) for p in points)


def test_farthest_by_rounds():
    seqs = sorted(set(loops(120, 4, low=6)))
    order = greedy.farthest(seqs, 10, 3)
    far = lambda i, chosen: min(distance(seqs[i], seqs[c]) / max(len(seqs[i]), len(seqs[c])) for c in chosen)
    for k in range(1, 10):
        rest = [i for i in range(len(seqs)) if i not in order[:k]]
        best = max(far(i, order[:k]) for i in rest)
        assert far(order[k], order[:k]) == pytest.approx(best) and order[k] == next(i for i in rest if far(i, order[:k]) == pytest.approx(best, abs=1e-12))
    mixed = seqs[::-1]
    assert mixed[greedy.farthest(mixed, 1, 3)[0]] == seqs[order[0]]
    assert sorted(greedy.farthest(["A", "A", "A"], 5, 1)) == [0, 1, 2] and greedy.farthest([], 3, 1) == []


def test_core_set_keeps_what_covers(spark):
    k = 6
    seqs = sorted(set(loops(900, 6, low=6)))
    frame = spark.createDataFrame([("G", f"s{i:04}", s) for i, s in enumerate(seqs)] + [("H", "x", "ACD"), ("H", "y", "ACW")], "v_gene string, seq_id string, cdr3_aa string")
    small = selection.core_set(frame, ["v_gene"], k, block=60).collect()
    by = {g: [r["cdr3_aa"] for r in small if r["v_gene"] == g] for g in "GH"}
    assert len(by["G"]) <= 60 and len(by["H"]) == 2 and set(by["G"]) <= set(seqs)
    picks = [by["G"][i] for i in greedy.farthest(sorted(by["G"]), k, 1)]
    whole = [seqs[i] for i in greedy.farthest(seqs, k, 1)]
    # farthest points of all are within twice the best radius, so the best is at least half of theirs
    assert radius(seqs, picks) <= 4 * radius(seqs, whole)
    spread = lambda ps: min(distance(a, b) / max(len(a), len(b)) for i, a in enumerate(ps) for b in ps[i + 1 :])
    assert spread(picks) >= spread(whole) / 3
    same = selection.core_set(frame, ["v_gene"], k)
    assert same.count() == frame.count()


def test_sample_as_in_one_task(spark, monkeypatch):
    rng = random.Random(2)
    seqs = sorted(set(loops(700, 9, low=8, high=20)))
    frame = spark.createDataFrame([(f"s{i:04}", rng.choice("XY"), s, len(s)) for i, s in enumerate(seqs)], "seq_id string, v_gene string, cdr3_aa string, cdr3_len int")
    panel = selection.Panel("p", {"X": 0.7, "Y": 0.3})
    one = [tuple(r) for r in selection.sample(frame, 20, panel).orderBy("rank").collect()]
    assert one == [tuple(r) for r in selection.sample(frame.repartition(5), 20, panel).orderBy("rank").collect()]
    assert len(one) == 20 and sum(r[1] == "X" for r in one) == 14
    monkeypatch.setattr(selection, "BLOCK", 1)  # blocks of four times the picks
    many = [tuple(r) for r in selection.sample(frame, 20, panel).collect()]
    assert len({r[2] for r in many}) == 20 and sum(r[1] == "X" for r in many) == 14


# ---------------------------------------------------------------- statistics


def test_quantiles(spark):
    rng = random.Random(1)
    data = {"a": [rng.randint(0, 9) for _ in range(501)], "b": [3], "c": [1, 2], "d": [rng.random() for _ in range(40)]}
    rows = [(g, float(v), 1) for g, vs in data.items() for v in vs] + [("a", None, 1), ("e", None, 1)]
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double, _n int"), "g", "v", points).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.quantile(vs, points), abs=1e-12)
    assert quantiles.quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", points).count() == 0


def test_quantiles_of_ten_million_rows_of_one_group(spark):
    rows = spark.range(10_000_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 31).alias("v"))
    (got,) = quantiles.quantiles(rows, "g", "v", [0.25, 0.5, 0.75]).collect()
    assert got["quantiles"] == pytest.approx([7, 15, 23], abs=1)


def test_deviation_is_exact(spark):
    values = [0.123456, 0.075427]
    for order in (values, values[::-1]):
        frame = spark.createDataFrame([(v,) for v in order], "v double")
        assert frame.agg(plates.exact_deviation(F.col("v"))).first()[0] == (0.123456 - 0.075427) / 2
    rng = random.Random(4)
    values = [round(rng.random() * 4, 6) for _ in range(96)]
    assert spark.createDataFrame([(v,) for v in values], "v double").agg(plates.exact_deviation(F.col("v"))).first()[0] == pytest.approx(np.std(values), rel=1e-12)


def folded(q, cutoff, minimum):
    total = start = 0
    best, first, last = 0.0, 0, 0
    for i, x in enumerate(q):
        total += 10.0 ** (-cutoff / 10) - 10.0 ** (-x / 10.0)
        if total > best:
            best, first, last = total, start, i + 1
        if total < 0:
            total, start = 0.0, i + 1
    return (first, last) if last - first >= minimum else (0, 0)


def test_trimming():
    rng = random.Random(6)
    arrays = [np.array([rng.randint(0, 60) for _ in range(rng.choice([0, 1, 19, 20, 21, 300]))]) for _ in range(200)] + [np.full(50, 20), np.tile([40, 2], 100), np.array([])]
    got = trim.best_segments([*arrays, None], 20, 20)
    assert [tuple(g) for g in got.tolist()] == [folded(a.tolist(), 20, 20) for a in arrays] + [(0, 0)]
    assert not math.isnan(trim.best_segments([], 20, 20).sum())


def test_a_barcode_on_two_plates_is_unresolved(spark):
    grids = spark.createDataFrame([(1, "sheet BC7 x"), (2, "sheet BC8 x"), (3, "none")], "grid_id int, text string")
    codes = spark.createDataFrame([("BC7", "P1"), ("BC7", "P2"), ("BC8", "P3"), ("BC8", "P3")], "barcode string, plate_id string")
    got = {r["grid_id"]: (r["source"], r["plate_id"], r["confidence"], r["alternatives"]) for r in assign.by_barcode(grids, codes).collect()}
    assert got == {1: ("unresolved", None, 0.0, ["P1", "P2"]), 2: ("barcode", "P3", 0.99, [])}


def test_batches_are_gone_through_in_parts(spark):
    """No helper holds more than a part of a batch; before, all rows of one were objects at once."""
    import pyarrow as pa

    from sparkwell.operators.spread import sliced

    batch = pa.RecordBatch.from_pydict({"q": [[1] * n for n in (5, 0, 7, 30, 2, 2)], "s": ["abc", None, "", "x", "y", "z"]})
    parts = list(sliced(batch, rows=3, size=12))
    assert [p["q"].to_pylist() for p in parts] == [batch["q"].to_pylist()[a:b] for a, b in ((0, 2), (2, 3), (3, 4), (4, 6))]
    assert [len(p) for p in sliced(batch, rows=4)] == [4, 2] and list(sliced(batch.slice(0, 0))) == []
    assert trim._coded([np.array([3, 40], np.int32), np.array([0], np.int32)])[0].dtype == np.uint8  # 1 byte a score; before, 8 in each of four arrays
    wide = [np.array([70000, 3, 3] * 20), np.array([-1, 300] * 20), np.array([2.5] * 30)]
    for some in (wide, wide[:1], wide[1:2], [np.array([300, 4] * 20)]):
        assert [tuple(x) for x in trim.best_segments(some, 20, 20).tolist()] == [folded(a.tolist(), 20, 20) for a in some]
    rng = random.Random(9)
    rows = [(i, [rng.randint(0, 60) for _ in range(rng.choice((0, 30, 400)))] if i % 7 else None) for i in range(3000)]
    frame = spark.createDataFrame([*rows, (-1, [40, None, 40] * 20)], "i int, q array<int>").coalesce(1)
    got = {r["i"]: r["t"] and tuple(r["t"]) for r in frame.select("i", sequencing.mott_trim(F.col("q")).alias("t")).collect()}
    assert got == {i: q if q is None else folded(q, 20, 20) for i, q in rows} | {-1: folded([40, 0, 40] * 20, 20, 20)}


def test_codon_choice_in_parts(spark):
    """Rows, columns and nulls beside the protein stay as they are over parts of a batch."""
    from sparkwell.kernels import codon
    from sparkwell.operators import construct

    rows = [(i, "MKVLAGGS" * (1 + i % 5), None if i % 3 else "x") for i in range(600)] + [(600, "MXM", "y"), (601, "", None)]
    got = {r["i"]: r for r in construct.optimize_codons(spark.createDataFrame(rows, "i int, insert_aa_seq string, note string").coalesce(1)).collect()}
    assert len(got) == len(rows)
    for i, protein, note in rows:
        made = codon.optimize(protein, ("BsaI", "BsmBI", "BbsI"))
        assert tuple(got[i])[1:] == (protein, note, made.dna, made.gc_swaps, made.sites_removed, "; ".join(made.problems))


def test_codon_rounds_equal_single_swaps():
    """Rounds told from the numbers of residues give what one swap after the other gives; repairs judged on a piece give what whole windows give. Before, each swap was sorted and each repair looked at a whole window."""
    import re

    from sparkwell.functions import dna
    from sparkwell.kernels import codon

    def flaws(text, sites):
        found = [(m.start(), m.start() + len(s), True) for s in sites for m in re.finditer(f"(?={s})", text)]
        return sorted(found + [(m.start(), m.end(), False) for m in re.finditer(r"([ACGT])\1{5,}", text)])

    def repaired(protein, text, sites):
        worth = lambda t: sum(1000 if x else b - a for a, b, x in flaws(t, sites))
        picked, n = [text[i : i + 3] for i in range(0, len(text), 3)], 0
        around = lambda i, j: "".join(picked[max(0, i - codon.MARGIN) : j + codon.MARGIN])
        waiting = [(x // 3, (y + 2) // 3) for x, y, _ in reversed(flaws(text, sites))]
        while waiting:
            first, last = waiting.pop()
            now, best = worth(around(first, last)), None
            for i in range(first, last) if now else ():
                old = picked[i]
                for c in codon.CHOICES[protein[i]]:
                    picked[i] = c
                    if c != old and (s := worth(around(first, last))) < now:
                        best = min(best or (s, -codon.USAGE[protein[i]][c], i, c), (s, -codon.USAGE[protein[i]][c], i, c))
                picked[i] = old
            if best:
                picked[best[2]], n, base = best[3], n + 1, max(0, first - codon.MARGIN)
                waiting += [(base + x // 3, base + (y + 2) // 3) for x, y, _ in reversed(flaws(around(first, last), sites))] if best[0] else []
        return "".join(picked), n

    rng = random.Random(21)
    enzymes = ("BsaI", "BsmBI", "BbsI")
    sites, swaps, repairs = dna.sites_to_avoid(list(enzymes)), 0, 0
    for k in range(240):
        letters = ("ACDEFGHIKLMNPQRSTVWY", "GAPR", "FKNIYM", "KFGP", "EDVLSR", "MW")[k % 6]
        protein = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 11, 12, 13, 40, 400))))
        text, n = codon._few_balanced(protein)
        assert codon._balanced(protein) == (text, n), protein
        made = codon.optimize(protein, enzymes)
        assert (made.dna, made.gc_swaps, made.sites_removed) == (repaired(protein, text, sites)[0], n, repaired(protein, text, sites)[1]), protein
        assert flaws(made.dna, sites) == codon._flaws(made.dna, sites)
        swaps, repairs = swaps + n, repairs + made.sites_removed
    assert swaps > 1000 and repairs > 100
