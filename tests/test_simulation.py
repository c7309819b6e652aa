"""Simulated plates and units, protocol steps, configuration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwell import lab
from sparkwell.operators import hits, plates, pool, protocol, simulate
from sparkwell.operators.filters import Filter


def test_pairs_have_truth_that_callers_find(spark):
    wells = simulate.simulate_pairs(spark, 40, seed=3, scenario="nominal", vary_fill=False, hit_rate=0.2).cache()
    assert wells.count() == 40 * 96 and wells.select("pair_id").distinct().count() == 40
    scored = hits.evaluate(wells, wells, callers=["ratio_over_blank"], respect_verdict=False)
    f1 = scored.agg(F.avg("f1")).first()[0]
    assert f1 > 0.5
    again = simulate.simulate_pairs(spark, 40, seed=3, scenario="nominal", vary_fill=False, hit_rate=0.2)
    assert wells.exceptAll(again).count() == 0
    assert wells.agg(F.max("od450_target")).first()[0] <= 4.0


def test_partly_filled_plates(spark):
    wells = simulate.simulate_pairs(spark, 30, seed=1)
    features = plates.plate_features(wells.select(F.col("pair_id").alias("plate_id"), "well", F.col("od450_target").alias("od450"), "role"))
    rows = features.collect()
    assert {round(r["fill_fraction"], 2) for r in rows} - {1.0} and all(r["blank_median"] < 0.3 for r in rows if r["fill_fraction"] < 1)
    with pytest.raises(KeyError):
        simulate.conditions_for("nope", "target", None)


def test_unit_goes_through_the_pool(spark):
    raw = simulate.simulate_unit(spark, 300, {"IGHV3-23": "EVQLLESGGGLVQPGGSLRLSCAAS", "IGHV1-69": "QVQLVQSGAEVKKPGSSVKVSCKAS"})
    rows = pool.normalize(raw, {"Species": "human"}, "sim")
    kept = Filter(genes=("IGHV3-23",)).apply(rows)
    assert 80 < kept.count() < 200
    assert rows.select("cdr3_aa").distinct().count() < 300


def test_steps(spark, tmp_path):
    plate = plates.fill(plates.blank_plate(spark, "P0"), spark.createDataFrame([("A1", "c1", 100.0, 1), ("B1", "c2", None, 2)], "well string, clone_id string, volume_ul double, ordinal int"))
    with pytest.raises(ValueError, match="takes a plate of"):
        protocol.STEPS.get("add_beads")().plan(plate, "P0", "dna")
    plan = protocol.STEPS.get("add_beads")().plan(plate, "P0", "supernatant", "P1", bead_slurry_ul=20)
    assert {r["clone_id"]: r["volume_ul"] for r in plan.wells.where("role = 'sample'").collect()} == {"c1": 120.0, "c2": 20.0}
    assert plan.transfers.count() == 0
    measured = plate.withColumn("concentration", F.when(F.col("clone_id") == "c1", 50.0))
    plan = protocol.STEPS.get("normalise")().plan(measured, "P1", "purified", "P2")
    assert [(r["source_well"], r["volume_ul"]) for r in plan.transfers.collect()] == [("A01", 20.0)]
    run = protocol.commit(plan, spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/transfers").first()["ordinal"] == 0
    assert spark.read.parquet(f"{tmp_path}/steps").first()["run_id"] == run
    assert protocol.STEPS.get("quantify_bli")().plan(plate, "P2", "purified").in_place
    assert {s["step"] for s in protocol.available()} == set(protocol.CHAIN)


def test_lab(tmp_path):
    path = tmp_path / "lab.json"
    lab.write({"instruments": {"cherry_pick": "tecan_evo"}, "other": 1}, path)
    got = lab.load(path, vendor="x")
    assert got["other"] == 1 and got["vendor"] == "x" and lab.instrument_for("cherry_pick", got) == "tecan_evo"
    with pytest.raises(KeyError):
        lab.instrument_for("none", got)
    path.write_text("{")
    with pytest.raises(ValueError):
        lab.load(path)
