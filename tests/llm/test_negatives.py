"""Hard negatives against a plain search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.llm import negatives
from sparkwell.llm.shared import Scratch

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
TABLE = "vec_id long, embedding array<float>, label int, row long, floor string, cell int"


def plainly(rows, anchor, positives=5, negatives=10):
    """(row number, key, ints, label) of the rows that take part, then all pairs."""
    usable = [(i, k, [math.floor(256 * float(x)) for x in v], t) for i, (k, v, t) in enumerate(rows) if k is not None and t is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, k, v, t in usable:
        if not anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), key, j, other) for j, key, w, other in usable if j != i]
        for p, positive, _, _ in sorted(s for s in scored if s[3] == t)[:positives]:
            near = sorted(s for s in scored if s[3] != t and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(k, positive, r + 1, n[1], -p, -n[0]) for r, n in enumerate(near)]
    return sorted(out)


def random_rows(n, seed, dim=6, spread=0.4, copies=0.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        v = [x + rng.gauss(0, spread) for x in c]
        rows.append([i, [float(np.float32(x)) for x in (centers[0] if rng.random() < copies else v)], rng.randrange(4)])
    return rows


def mined(spark, rows, every=10, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TABLE).repartition(5)
    scratch = Scratch(spark, "test")
    got = sorted(tuple(r[c] for c in NAMES) for r in negatives.hard_negatives(frame, F.col("vec_id") % every == 0, scratch=scratch, **more).collect())
    scratch.close()
    return got


@pytest.mark.parametrize(("spread", "copies", "pivots"), [(0.05, 0.0, 16), (1.0, 0.4, 64), (0.4, 0.0, 1)])
def test_equals_a_plain_search(spark, monkeypatch, spread, copies, pivots):
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rows = random_rows(600, 1, spread=spread, copies=copies)
    assert mined(spark, rows, pivots=pivots) == plainly(rows, lambda k: k % 10 == 0)


def test_rows_that_take_no_part(spark):
    rows = random_rows(120, 3)
    rows[3][1] = None
    rows[4][1] = [None, *rows[4][1][1:]]
    rows[10][1] = [float("nan"), *rows[10][1][1:]]
    rows[20][1] = [float("inf"), *rows[20][1][1:]]
    rows[30][2] = None
    rows[7][0] = None
    want = plainly(rows, lambda k: k % 10 == 0)
    assert mined(spark, [*rows, [500, [1.0, 2.0], 1], [501, [], 2]]) == want
    assert want


def test_repeated_rows_ties_and_signs(spark):
    rows = random_rows(60, 5)
    rows += [list(r) for r in rows[:25]]
    assert mined(spark, rows) == plainly(rows, lambda k: k % 10 == 0)
    zero = [[i, [0.0, 0.0], i % 2] for i in range(24)]
    assert mined(spark, zero) == plainly(zero, lambda k: k % 10 == 0)
    one = [[i, [float(i - 4)], i % 3] for i in range(30)]
    assert mined(spark, one) == plainly(one, lambda k: k % 10 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [[i, [float(np.float32(rng.uniform(0.5, 1) * 2**20)) for _ in range(4)], i % 3] for i in range(80)]
    assert mined(spark, rows) == plainly(rows, lambda k: k % 10 == 0)
    with pytest.raises(ArithmeticError):
        mined(spark, [[0, [1e20], 1], [1, [1.0], 2]])


def test_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [[1, [1.0], 1]]) == []
    assert mined(spark, [[0, [1.0], 1]]) == []
    assert mined(spark, [[0, None, 1], [None, [1.0], 2]]) == []


def test_best_by_hand():
    scores = np.array([[3, 5, 5, 1], [0, 0, 0, 0]])
    allowed = np.array([[True, True, True, True], [False, True, True, False]])
    for s in (scores, scores * 2**60):
        line, column = negatives.best(s, allowed, 1)
        assert list(zip(line.tolist(), column.tolist(), strict=True)) == [(0, 1), (1, 1)]


def test_rings_leave_far_cells_out(spark):
    """Two far clusters: an anchor's candidates come from its own."""
    rng = random.Random(4)
    rows = [[i, [(40 if i % 2 else -40) + rng.gauss(0, 0.1), rng.gauss(0, 0.1)], (i // 2) % 2] for i in range(400)]
    space = negatives.Space(2, max(sum((256 * x) ** 2 for x in v) for _, v, _ in rows), "<i4", np.array([[-10240.0, 0.0], [10240.0, 0.0]]), 256.0)
    cells = negatives.Cells(np.array([0.0, 0.0]), np.array([2000.0, 2000.0]), [1, 1], [0, 0], [1, 1])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([np.array([-10240, 0], "<i4").tobytes()], pa.binary()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([100_000_000], pa.int64())], names=["vec", "cell", "grp", "floor"])
    told = [r for b in negatives._rings(space, cells, "floor", None)([batch]) for r in b.to_pylist()]
    assert [r["cell"] for r in told] == [0]
    assert mined(spark, rows, pivots=8) == plainly(rows, lambda k: k % 10 == 0)
