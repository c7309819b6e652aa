"""Scalar functions against their definitions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwell.functions import dna, ids, imgt, wells
from sparkwell.functions import germline as g
from sparkwell.kernels import local


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in values.items()))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(("call", "gene", "family", "allele", "chain"), [("IGHV3-23*04, IGHV3-23D*01", "IGHV3-23", "IGHV3", "04", "H"), ("IGKV1-39", "IGKV1-39", "IGKV1", None, "L"), ("XX", "XX", None, None, None), ("", None, None, None, None), (None, None, None, None, None)])
def test_calls(spark, call, gene, family, allele, chain):
    c = F.lit(call).cast("string")
    got = spark.range(1).select(g.gene(c), g.family(c), g.allele(c), g.chain_of(c)).first()
    assert tuple(got) == (gene, family, allele, chain)


@pytest.mark.parametrize(("status", "liable"), [(None, False), ("", False), ("||", False), (" fw1 is Shorter than IMGT defined |", False), ("Deletions: 10", False), ("Deletions: 10|Insertion: 5", True), ("new flag", True)])
def test_liability(spark, status, liable):
    assert spark.range(1).select(g.has_liability(F.lit(status).cast("string"))).first()[0] is liable


@pytest.mark.parametrize(("raw", "well"), [("a1", "A01"), (" A 01 ", "A01"), ("1A", "A01"), ("12h", "H12"), ("A13", None), ("I1", None), ("A0", None), ("", None), ("A001", "A01"), (None, None)])
def test_wells(spark, raw, well):
    assert spark.range(1).select(wells.normalize(F.lit(raw).cast("string"))).first()[0] == well


def test_well_places(spark):
    for fmt, (rows, cols) in wells.FORMATS.items():
        plate = wells.all_wells(spark, fmt)
        w = F.col("well")
        rows_ = plate.select("place_down", "place_along", wells.column_major(w, fmt).alias("d"), wells.row_major(w, fmt).alias("a"), wells.at_column_major(F.col("place_down"), fmt).alias("w1"), wells.at_row_major(F.col("place_along"), fmt).alias("w2"), "well").collect()
        assert len(rows_) == rows * cols
        assert all(r["d"] == r["place_down"] and r["a"] == r["place_along"] and r["w1"] == r["w2"] == r["well"] for r in rows_)
    with pytest.raises(ValueError, match="format"):
        wells.dims(97)
    with pytest.raises(Exception, match="no well"):
        spark.range(1).select(wells.normalize(F.lit("Z9"), strict=True)).collect()


@settings(max_examples=25, deadline=None)
@given(st.text("ACGTN", max_size=700), st.integers(1, 14))
def test_kmers(spark, seq, k):
    want = [(seq[i : i + k], i) for i in range(len(seq) - k + 1) if "N" not in seq[i : i + k]]
    got = spark.range(1).select(dna.kmers(F.lit(seq), k)).first()[0]
    assert [(r["kmer"], r["position"]) for r in got] == want


@settings(max_examples=25, deadline=None)
@given(st.text("ACGT", max_size=60))
def test_dna(spark, seq):
    c = F.lit(seq)
    rc, gc, protein = spark.range(1).select(dna.reverse_complement(c), dna.gc_fraction(c), dna.translate(c)).first()
    assert rc == dna.complement_of(seq)
    assert dna.complement_of(rc) == seq
    assert gc == pytest.approx(sum(x in "GC" for x in seq) / max(1, len(seq)))
    assert protein == local.translate(seq)


def test_code_and_sites():
    assert dna.CODONS["ATG"] == "M" and dna.CODONS["TGG"] == "W" and sorted(c for c, r in dna.CODONS.items() if r == "*") == ["TAA", "TAG", "TGA"]
    assert dna.sites_to_avoid(["BsaI", "BsmBI", "Esp3I"]) == ["GGTCTC", "GAGACC", "CGTCTC", "GAGACG"]
    with pytest.raises(KeyError):
        dna.sites_to_avoid(["Nope"])


def test_protein_changes(spark):
    change = lambda a, b: spark.range(1).select(dna.protein_changes(F.lit(a), F.lit(b))).first()[0]
    assert change("MAT", "MAT") == []
    assert change("MAT", "MGT") == ["A2G"]
    assert change("MAT", "MGTS") == ["A2G", "length 3->4"]


def test_imgt_order(spark):
    positions = ["112", "112A", "112B", "111A", "111", "113", "junk", "1"]
    frame = spark.createDataFrame([(p,) for p in positions], "p string")
    assert [r["p"] for r in frame.orderBy(imgt.position_key(F.col("p"))).collect()] == ["1", "111", "111A", "112B", "112A", "112", "113", "junk"]
    assert [spark.range(1).select(imgt.region_of(F.lit(n))).first()[0] for n in (26, 27, 104, 105, 117, 118, 129)] == ["FR1", "CDR1", "FR3", "CDR3", "CDR3", "FR4", None]


def test_ids(spark):
    assert ids.parse(ids.mint("PLT", "x")) == ("PLT", "x")
    with pytest.raises(KeyError):
        ids.mint("ZZ")
    with pytest.raises(ValueError):
        ids.parse("PLT-")
    a, b = spark.range(1).select(ids.content_id("SEQ", F.lit("u"), F.lit("AC")), ids.content_id("SEQ", F.lit("u"), F.lit("AC"))).first()
    assert a == b and a.startswith("SEQ-")
