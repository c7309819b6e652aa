"""Readers on files written here."""

from __future__ import annotations

import gzip
import json
import struct
import time

import pytest

from sparkwell.operators.filters import Filter
from sparkwell.sinks.bundle import Bundle, describe, read_manifest
from sparkwell.sources import binary, fasta, grids, repertoire
from sparkwell.streaming import append_to_pool, pool_stream

HEADER = "v_call,j_call,sequence_alignment_aa,cdr3_aa,productive,Redundancy,ANARCI_status"
LINES = ['"IGHV3-23*01,IGHV3-23D*01",IGHJ4*02,QV-QL..VX,CARDY,T,3,', "IGHV1-69*01,IGHJ4*02,QVQLV,CARDYW,F,,Insertion: 5", "IGHV1-69*01,IGHJ4*02,EVQLV,,T,x,", "IGHV1-69*01,IGHJ4*02,EVQLV,CARW,T,1,"]


@pytest.fixture
def unit(tmp_path):
    path = tmp_path / "unit.csv.gz"
    meta = json.dumps({"Species": "human", "Author": "A et al.", "Isotype": "IGHG"}).replace('"', '""')
    path.write_bytes(gzip.compress(("\n".join([f'"{meta}"', HEADER, *LINES]) + "\n").encode()))
    return str(path)


def test_unit(spark, unit):
    assert repertoire.read_metadata(spark, unit)["Species"] == "human"
    rows, meta, scanned, kept = repertoire.load_unit(spark, unit, Filter(max_ambiguous=None))
    got = {(r["v_gene"], r["aa_seq"], r["cdr3_len"], r["redundancy"], r["species"], r["isotype"]) for r in rows.collect()}
    assert ("IGHV3-23", "QVQLVX", 5, 3, "human", "IGHG") in got
    assert len(got) == 2  # one is unproductive; two have one id


def test_shards(spark, tmp_path):
    spark.createDataFrame([("human", "a"), ("mouse", "b")], "meta_Species string, x string").coalesce(1).write.parquet(f"{tmp_path}/heavy/Some_Study")
    files = repertoire.study_files(spark, str(tmp_path), "some study")
    assert repertoire.read_shards(spark, files, ["x", "absent"], "Human").count() == 1
    with pytest.raises(KeyError):
        repertoire.study_files(spark, str(tmp_path), "other")


def test_traces(spark, tmp_path):
    entries = {("PBAS", 2): (2, 12, b"ACGTACGTACGT"), ("PCON", 2): (2, 12, bytes([40] * 10 + [5] * 2)), ("SMPL", 1): (18, 4, b"\x03S_1"), ("TUBE", 1): (19, 3, b"A1\0"), ("RUND", 1): (10, 1, struct.pack(">hBB", 2024, 5, 6)), ("RUNT", 1): (11, 1, bytes([7, 8, 9, 0]))}
    (tmp_path / "good.ab1").write_bytes(binary.write_abif(entries))
    (tmp_path / "bad.ab1").write_bytes(b"nothing")
    got = {r["file"]: r for r in binary.read_traces(spark, str(tmp_path)).collect()}
    good = got["good.ab1"]
    assert (good["sequence"], good["sample"], good["well"], good["q20"]) == ("ACGTACGTACGT", "S_1", "A1", 10)
    assert str(good["run_started"]) == "2024-05-06 07:08:09"
    assert got["bad.ab1"]["problem"]


def test_plasmids(spark, tmp_path):
    xml = b'<Features><Feature name="CMV" type="promoter" directionality="1"><Segment range="3-6"/><Q name="note"><V text="a &lt;b&gt;note"/></Q></Feature></Features>'
    part = lambda kind, data: bytes([kind]) + struct.pack(">I", len(data)) + data
    data = part(9, b"SnapGene\0\1") + part(0, b"\x01ACGTACGTAC") + part(10, xml)
    (tmp_path / "p.dna").write_bytes(data)
    row = binary.read_plasmids(spark, f"{tmp_path}/p.dna").first()
    assert (row["circular"], row["length"], row["feature"], row["start"], row["end"], row["strand"]) == (True, 10, "CMV", 2, 6, 1)
    p = binary.parse_plasmid(data)
    assert p.slice(8, 2) == "ACAC" and p.problems(11, ("cmv", "bGH")) == ["10 bp instead of 11", "feature 'bGH' is missing"]
    with pytest.raises(ValueError):
        binary.parse_plasmid(b"GENBANK")


def test_grids(spark, tmp_path):
    body = ["Read,450", ",," + ",".join(map(str, range(1, 13)))] + [f",{c}," + ",".join(["0.1", "OVRFLW", ""] + ["0.2"] * 9) for c in "ABCDEFGH"]
    (tmp_path / "g.csv").write_text("\n".join(body + ["", ",1,2,3", "A,1,1,1"]))
    got = grids.read(spark, str(tmp_path / "g.csv"), "grid_csv").collect()
    assert len(got) == 8 * 11 and {r["od450"] for r in got if r["well"].endswith("02")} == {float("inf")}
    assert all("Read 450" in r["text"] for r in got)
    (tmp_path / "l.csv").write_text("well,od450\na1,0.5\nB2,OVER\n")
    assert {(r["well"], r["od450"]) for r in grids.read(spark, str(tmp_path / "l.csv"), "long_csv").collect()} == {("A01", 0.5), ("B02", float("inf"))}


def test_germlines(spark, tmp_path):
    (tmp_path / "g.fasta").write_text(">M1|IGHV1-2*02|human|F|\nqv.q\nlv\n>M2|IGHV1-2*01|human|F|\nEV..L\n")
    rows = fasta.read_germlines(spark, str(tmp_path / "g.fasta")).collect()
    assert [(r["gene"], r["allele"], r["sequence"]) for r in rows] == [("IGHV1-2", "01", "EVL")]
    genes = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    source = lambda *r: spark.createDataFrame(list(r), "gene string, sequence string")
    got = {tuple(r) for r in fasta.resolve(genes, [("one", source(("a", "X"))), ("two", source(("a", "Y"), ("b", "Z")))]).collect()}
    assert got == {("a", "X", "one"), ("b", "Z", "two"), ("c", None, None)}


def test_stream_appends_once(spark, tmp_path):
    raw = spark.createDataFrame([("IGHV3-23*01", "QVQ", "CAR"), ("IGHV3-23*01", "EVQ", "CAK")], "v_call string, sequence_alignment_aa string, cdr3_aa string")
    raw.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run = lambda: append_to_pool(pool_stream(spark, f"{tmp_path}/in/*", raw.schema, {}, "unit"), f"{tmp_path}/pool", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    run()
    time.sleep(0.1)
    raw.unionByName(spark.createDataFrame([("IGHV3-23*01", "DVQ", "CAE")], raw.schema)).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert sorted(r["aa_seq"] for r in spark.read.parquet(f"{tmp_path}/pool").collect()) == ["DVQ", "EVQ", "QVQ"]


def test_bundle(spark, tmp_path):
    b = Bundle(tmp_path / "run", "selection")
    b.section("s", {"a": 1})
    b.section("s", {"b": {2, 1}})
    b.write_table("t", spark.range(3))
    b.close()
    assert read_manifest(tmp_path / "run")["sections"]["s"] == {"a": 1, "b": [1, 2]} and "1 files" in describe(tmp_path / "run")


def test_volumes_of_lines(spark):
    """Two places as a formatter writes them, for any number; only odd ones go to the formatter, before, all did."""
    from pyspark.sql import functions as F

    from sparkwell.sinks import worklists

    volumes = [1.0, 0.125, 1.005, 49.999, 2.675, 0.0, -0.001, -3.5, 1e17, float("nan"), None]
    frame = spark.createDataFrame([(i, "A1", "b02" if i % 2 else None, v) for i, v in enumerate(volumes)], "ordinal int, source_well string, dest_well string, volume_ul double")
    want = {r["ordinal"]: r["x"] for r in frame.select("ordinal", F.format_string('    pipette.transfer(%.2f, source["%s"], destination["%s"])', "volume_ul", F.lit("A01"), F.when(F.col("dest_well").isNotNull(), "B02")).alias("x")).collect()}
    assert {r["ordinal"]: r["line"] for r in worklists.emit(frame, "opentrons", allow_unverified=True).collect()} == want
