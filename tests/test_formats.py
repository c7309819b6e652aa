"""Formats of ``spark.read`` on files written here: plan, choice of files, modes."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkwell.sinks.units import write_units
from sparkwell.sources import binary, formats, repertoire
from sparkwell.streaming import trace_stream


def head(**meta):
    return '"' + json.dumps(meta).replace('"', '""') + '"\nv_call,cdr3_aa,n\n'


def rows_of(frame):
    return sorted(((r["v_call"], r["cdr3_aa"], r["n"]) for r in frame.collect()), key=str)


@pytest.fixture
def units(spark, tmp_path):
    formats.register(spark)
    for study, k in (("a", 400), ("b", 300)):
        (tmp_path / study).mkdir()
        body = "".join(f'"IGHV{i % 7},x",{"C" * (i % 90)},{i}\n' for i in range(k))
        (tmp_path / study / "one.csv").write_text(head(Study=study, Depth=3) + body)
        (tmp_path / study / "two.csv.gz").write_bytes(gzip.compress((head(Study=study) + body).encode()))
    (tmp_path / "_hidden.csv").write_text("no unit")
    return str(tmp_path)


def want(study, k):
    return sorted(((f"IGHV{i % 7},x", "C" * (i % 90) or None, str(i)) for i in range(k)), key=str)


@pytest.mark.parametrize("size", [1, 7, 100, 5000, 1 << 26])
def test_cuts_lose_and_double_no_row(spark, units, size):
    frame = spark.read.format("repertoire_unit").option("bytesPerPartition", max(size, 90)).load(units + "/a/one.csv")
    assert rows_of(frame) == want("a", 400)
    reader = formats.UnitReader({"path": units + "/a/one.csv", "bytesPerPartition": str(size)}, frame.schema)
    store = formats.file_system(units)[0]
    got = [row["n"] for part in reader.partitions() for piece in part.pieces for row in reader.rows(store, piece)]
    assert got == [str(i) for i in range(400)]


def test_units(spark, units):
    frame = spark.read.format("repertoire_unit").load(units)
    assert rows_of(frame) == sorted((want("a", 400) + want("b", 300)) * 2, key=str)
    assert {(r["_unit"], r["_meta"]["Study"], r["_meta"].get("Depth")) for r in frame.select("_unit", "_meta").collect()} == {("a/one.csv", "a", "3"), ("a/two.csv.gz", "a", None), ("b/one.csv", "b", "3"), ("b/two.csv.gz", "b", None)}
    own = repertoire.read_unit(spark, units + "/a/one.csv")
    assert rows_of(own) == rows_of(frame.where("_unit = 'a/one.csv'").select(*own.columns))


def test_files_are_chosen_before_partitions_are_planned(spark, units):
    frame = spark.read.format("repertoire_unit").option("bytesPerPartition", 2000).load(units)
    parts = lambda f: f.rdd.getNumPartitions()
    everything = parts(frame)
    assert 1 == parts(frame.where("_unit = 'a/two.csv.gz'")) < parts(frame.where("_unit LIKE 'a/%'")) < everything
    assert parts(frame.where(F.col("_unit").isin("a/two.csv.gz", "b/two.csv.gz"))) == 2
    assert frame.where("_unit = 'b/one.csv' AND v_call = 'IGHV3,x'").count() == sum(i % 7 == 3 for i in range(300))
    assert frame.where("_unit = 'none'").count() == 0


def test_a_given_schema_chooses_columns(spark, units):
    frame = spark.read.format("repertoire_unit").schema("n string, absent string").load(units + "/b/one.csv")
    assert frame.columns == ["n", "absent"] and sorted(int(r["n"]) for r in frame.collect()) == list(range(300))
    assert frame.where("absent IS NOT NULL").count() == 0


def test_modes_of_units(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.csv").write_text(head() + "v,c,1\nv,c\n\nv,c,2,more\n")
    (tmp_path / "b.csv").write_text("no json\nx\n")
    (tmp_path / "c.csv").write_text("")
    load = lambda mode: spark.read.format("repertoire_unit").option("mode", mode).load(str(tmp_path))
    kept = {(r["_unit"], r["n"], r["_problem"]) for r in load("permissive").collect()}
    assert ("a.csv", "1", None) in kept and ("a.csv", None, "2 cells instead of 3") in kept and ("a.csv", "2", "4 cells instead of 3") in kept
    assert len(kept) == 4 and any(u == "b.csv" and p for u, _, p in kept)
    assert rows_of(load("DROPMALFORMED")) == [("v", "c", "1")]
    with pytest.raises(PySparkException, match="cells instead"):
        load("FAILFAST").collect()


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("repertoire_unit").load(str(tmp_path)).count() == 0
    with pytest.raises(PySparkException, match="absent"):
        spark.read.format("abif_trace").load(f"{tmp_path}/absent").count()


def test_traces(spark, tmp_path):
    formats.register(spark)
    for k in range(6):
        (tmp_path / f"p{k % 2}_{k}.ab1").write_bytes(binary.write_abif({("PBAS", 2): (2, 4, b"ACGT"), ("PCON", 2): (2, 4, bytes([40, 40, 5, 30 + k])), ("SMPL", 1): (18, 4, b"\x03S_1"), ("RUND", 1): (10, 1, b"\x07\xe8\x05\x06"), ("RUNT", 1): (11, 1, bytes([7, 8, 9, 0]))}))
    (tmp_path / "p9.ab1").write_bytes(b"nothing")
    load = lambda **o: spark.read.format("abif_trace").options(**o).load(str(tmp_path))
    old = binary.read_traces(spark, str(tmp_path))
    assert sorted(map(str, load().select(*old.columns).collect())) == sorted(map(str, old.collect()))
    assert load(mode="DROPMALFORMED").count() == 6 and load(pathGlobFilter="p1*").count() == 3
    assert load(bytesPerPartition=1).rdd.getNumPartitions() == 7 and load(bytesPerPartition=1).where("file LIKE 'p0%'").rdd.getNumPartitions() == 3
    with pytest.raises(PySparkException, match="p9.ab1"):
        load(mode="FAILFAST").collect()


def test_plasmids(spark, tmp_path):
    formats.register(spark)
    part = lambda kind, data: bytes([kind]) + len(data).to_bytes(4, "big") + data
    xml = b'<Features><Feature name="CMV" type="promoter" directionality="1"><Segment range="3-6"/></Feature></Features>'
    (tmp_path / "p.dna").write_bytes(part(9, b"SnapGene\0\1") + part(0, b"\x01ACGTACGTAC") + part(10, xml))
    (tmp_path / "q.dna").write_bytes(part(9, b"SnapGene\0\1") + part(0, b"\x00ACGT"))
    (tmp_path / "bad.dna").write_bytes(b"x")
    got = {r["file"]: r for r in spark.read.format("plasmid_map").load(str(tmp_path)).collect()}
    assert (got["p.dna"]["feature"], got["p.dna"]["start"], got["p.dna"]["end"], got["p.dna"]["sequence"]) == ("CMV", 2, 6, "ACGTACGTAC")
    assert got["q.dna"]["feature"] is None and got["q.dna"]["length"] == 4 and got["bad.dna"]["problem"]


def test_units_round_trip(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([(1, 'a,"b"', "x\ny"), (2, None, " é "), (3, "", None)], "id long, `a.b` string, c string").repartition(3)
    write_units(rows, f"{tmp_path}/u", {"Species": "human, \"mouse\""})
    got = spark.read.format("repertoire_unit").load(f"{tmp_path}/u").collect()
    assert sorted((r["id"], r["a.b"] or "", r["c"] or "", r["_meta"]["Species"], r["_problem"]) for r in got) == [(str(i), a, c, 'human, "mouse"', None) for i, a, c in ((1, 'a,"b"', "x y"), (2, "", " é "), (3, "", ""))]


def test_trace_stream(spark, tmp_path):
    trace = lambda s: binary.write_abif({("PBAS", 2): (2, 4, s), ("PCON", 2): (2, 4, bytes([40] * 4))})
    (tmp_path / "in").mkdir()
    for step, name in enumerate(("a.ab1", "b.ab1")):
        (tmp_path / "in" / name).write_bytes(trace(b"ACG" + b"TA"[step : step + 1]))
        writer = trace_stream(spark, f"{tmp_path}/in").writeStream.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    assert sorted((r["file"], r["sequence"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a.ab1", "ACGT"), ("b.ab1", "ACGA")]
