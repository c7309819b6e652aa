"""Operators on small frames, edge cases first."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkwell.kernels import codon, gotoh, greedy, local
from sparkwell.operators import alignment, assign, construct, hits, ledger, plates, pool, selection, sequencing
from sparkwell.operators.filters import Filter
from sparkwell.registry import Registry
from sparkwell.sinks import forms, worklists


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_filter_and_funnel_agree(spark):
    frame = spark.createDataFrame([("s1", "T", "H", "G", 10, None, None, 0, "AA"), ("s2", None, "H", "G", 10, 2, False, None, "AA"), ("s3", "F", "H", "G", 10, 2, False, 0, "BB"), ("s4", "", "L", "G", 10, 2, False, 0, "CC"), ("s5", "1", "H", "G", 10, 2, True, 0, "DD")], "seq_id string, productive string, chain string, v_gene string, cdr3_len int, redundancy int, has_liability boolean, n_ambiguous int, cdr3_aa string")
    keep = Filter(chain="H", min_redundancy=1, drop_duplicate_cdr3=True)
    assert [r["seq_id"] for r in keep.apply(frame).collect()] == ["s1"]
    funnel = keep.explain(frame).orderBy("place").collect()
    assert [r["rows"] for r in funnel] == [5, 4, 3, 3, 2, 2, 1]
    assert funnel[-1]["dropped"] == 1
    assert keep.apply(frame.limit(0)).count() == 0


def test_ingest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "seq_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "seq_id string, v int")
    assert rows(pool.append_new(old, new)) == [("c", 2)]
    assert rows(pool.refreshed(old, new)) == [("a", 1), ("b", 2), ("c", 2)]
    assert tuple(pool.consistency(old, new).first()) == (2, 2, 1, 1, False)
    assert tuple(pool.consistency(old, old).first()) == (2, 2, 0, 0, True)


def test_quotas():
    p = selection.PANELS["default-v1"]
    assert p.quotas(96) == {"IGHV3-23": 58, "IGHV1-69": 24, "IGHV3-53": 14}
    assert sum(p.quotas(3).values()) == 3 and min(p.quotas(3).values()) == 1
    with pytest.raises(ValueError):
        p.quotas(2)


def test_farthest_spreads():
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACDEFG") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    picked = greedy.farthest(seqs, 10, 42)
    codes, sizes = greedy.encode(seqs)
    worst = lambda ids: max(greedy.identities(i, codes, sizes)[j] for i in ids for j in ids if i != j)
    assert len(set(picked)) == 10
    assert worst(picked) <= min(worst(rng.sample(range(60), 10)) for _ in range(20))
    assert sorted(greedy.seriate(seqs)) == list(range(60))


def test_sample_is_whole(spark):
    rng = random.Random(2)
    data = [(f"s{i}", rng.choice(["X", "Y"]), "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(6, 14)))) for i in range(200)]
    frame = spark.createDataFrame([(a, b, c, len(c)) for a, b, c in data], "seq_id string, v_gene string, cdr3_aa string, cdr3_len int")
    got = selection.sample(frame, 20, selection.Panel("p", {"X": 0.7, "Y": 0.3})).collect()
    assert len(got) == 20 and len({r["cdr3_aa"] for r in got}) == 20
    assert sum(r["v_gene"] == "X" for r in got) == 14


def plate(spark, values):
    return spark.createDataFrame([("p", f"{'ABCDEFGH'[i % 8]}{i // 8 + 1:02d}", float(t), float(c)) for i, (t, c) in enumerate(values)], "pair_id string, well string, od450_target double, od450_control double")


def test_robust_z_without_spread(spark):
    frame = plate(spark, [(3.0, 0.05)] * 16 + [(0.05, 0.05)] * 80)
    assert hits.call(frame, "robust_z").where("is_hit").count() == 16
    assert hits.plate_health(frame).first()["verdict"] == hits.CALLABLE
    flat = plate(spark, [(0.5, 0.4)] * 96)
    assert hits.plate_health(flat).first()["verdict"] == hits.UNCALLABLE
    truth = flat.select("pair_id", "well", F.lit(True).alias("is_binder"))
    scored = hits.evaluate(flat, truth).collect()
    assert {r["caller"] for r in scored} == set(hits.CALLERS) and all(r["f1"] == 0 and r["precision"] is None for r in scored)


def test_both_rules_call_no_more_than_either(spark):
    rng = random.Random(3)
    frame = plate(spark, [(rng.random() * 4, rng.random()) for _ in range(96)])
    n = {c: hits.call(frame, c).where("is_hit").count() for c in hits.CALLERS}
    assert n["ratio_and_z"] <= min(n["ratio_over_blank"], n["robust_z"])


def test_plate_fill_and_trace(spark):
    empty = plates.blank_plate(spark, "P")
    data = spark.createDataFrame([("a1", "c1", 1.0, 1), ("A01", "c2", 2.0, 2), ("h12", "c3", None, 3)], "well string, clone_id string, volume_ul double, ordinal int")
    got = {r["well"]: r["clone_id"] for r in plates.fill(empty, data).where("role = 'sample'").collect()}
    assert got == {"A01": "c2", "H12": "c3"}
    links = spark.createDataFrame([("p3", "A01", "p2", "A01"), ("p2", "A01", "p1", "B01"), ("p1", "B01", "p3", "A01")], "plate_id string, well string, source_plate_id string, source_well string")
    chain = plates.trace_wells(links, links.where("plate_id = 'p3'")).orderBy("depth").collect()
    assert [(r["plate_id"], r["well"]) for r in chain] == [("p3", "A01"), ("p2", "A01"), ("p1", "B01")]


def test_ledger(spark):
    links = spark.createDataFrame([("a", "b", "made"), ("b", "c", "made"), ("a", "c", "made"), ("c", "a", "odd")], ledger.LINK_SCHEMA)
    start = spark.createDataFrame([("c",)], "obj_id string")
    assert {(r["obj_id"], r["depth"]) for r in ledger.lineage(links, start).collect()} == {("a", 1), ("b", 1)}
    art = spark.createDataFrame([("a", "t", '{"k": 1, "s": "x"}'), ("b", "t", None)], "obj_id string, obj_type string, meta_json string")
    assert [r["obj_id"] for r in ledger.find(art, "t", k=1).collect()] == ["a"]
    changed = ledger.set_meta(art, spark.createDataFrame([("a", "k", "9")], "obj_id string, key string, value string"))
    assert [r["obj_id"] for r in ledger.find(changed, s="x", k=9).collect()] == ["a"]
    assert [r["obj_id"] for r in ledger.current(art, ledger.supersede(links, spark.createDataFrame([("a", "z")], "old_id string, new_id string"))).collect()] == ["b"]


def test_two_barcodes_are_unresolved(spark):
    grids = spark.createDataFrame([("g1", "BC1 and BC2"), ("g2", "bc1 target"), ("g3", "plate alpha"), ("g4", "")], "grid_id string, text string")
    codes = spark.createDataFrame([("BC1", "P1"), ("BC2", "P2")], "barcode string, plate_id string")
    names = spark.createDataFrame([("alpha", "P3"), ("abc", "P4")], "name string, plate_id string")
    got = {r["grid_id"]: (r["source"], r["plate_id"], r["plate_kind"]) for r in assign.propose(grids, codes, names).collect()}
    assert got == {"g1": ("unresolved", None, None), "g2": ("barcode", "P1", "target"), "g3": ("name", "P3", None), "g4": ("unresolved", None, None)}


def test_reruns(spark):
    data = [("f1", "S1", 1, 50), ("f2", "S1_rerun", 2, 40), ("f3", "S2", None, 9), ("f4", "S2-redo", 2, 9), ("f5", "S3_2", 1, 9)]
    frame = spark.createDataFrame(data, "file string, sample string, run_started int, q20 int")
    got = {r["file"]: (r["stem"], r["status"], bool(r["warning"])) for r in sequencing.resolve_reruns(frame).collect()}
    assert got == {"f1": ("S1", "superseded", False), "f2": ("S1", "kept", True), "f3": ("S2", "unresolved", False), "f4": ("S2", "unresolved", False), "f5": ("S3_2", "only", False)}


def test_stems(spark):
    """Every mark of a rerun goes, repeatedly, but only after a separator."""
    stems = {"P3_RR": "P3", "P3-v2": "P3", "P3.r2": "P3", "P3 (1)": "P3", "P3(2)_run9 -Redo ": "P3", "P3_re-run_rerun": "P3", " P3_": "P3", "P3repeat": "P3repeat", "torredo": "torredo", "P3_2": "P3_2", "P3_v1": "P3_v1", "P3_r10": "P3_r10", "_rerun": "_rerun", "_rerun_RR": "rerun", "(1) (2)": "(1)", "P3\u00a0(٣)": "P3", "": ""}
    frame = spark.createDataFrame([(k,) for k in [*stems, None]], "sample string")
    assert {r["sample"]: r["stem"] for r in frame.select("sample", sequencing.stem_of(F.col("sample")).alias("stem")).collect()} == stems | {None: None}


def test_mott(spark):
    good = [2] * 10 + [40] * 30 + [2] * 10
    frame = spark.createDataFrame([(1, good), (2, [40] * 19), (3, [])], "i int, q array<int>")
    got = {r["i"]: tuple(r["t"]) for r in frame.select("i", sequencing.mott_trim(F.col("q")).alias("t")).collect()}
    assert got == {1: (10, 40), 2: (0, 0), 3: (0, 0)}


INSERT, OTHER, NOISE = ("".join(random.Random(seed).choices("ACGT", k=300)) for seed in (7, 8, 9))


def syn(at):
    """A synonymous change at a codon."""
    c = INSERT[at : at + 3]
    from sparkwell.functions.dna import CODONS

    return next((INSERT[:at] + d + INSERT[at + 3 :] for d in CODONS if d != c and CODONS[d] == CODONS[c] and sum(x != y for x, y in zip(c, d, strict=True)) == 1), None)


@pytest.mark.parametrize(
    ("read", "verdict"),
    [
        (INSERT, "exact"), (local.complement_of(INSERT), "exact"), (INSERT[:50], "low_quality"), (OTHER, "wrong_clone"), (next(s for s in map(syn, range(90, 200, 3)) if s), "silent"), (INSERT[:150] + INSERT[151:], "frameshift"),
        (INSERT[:150] + INSERT[153:], "indel"), (NOISE, "unreadable"), (INSERT[:120] + "R" * 8 + INSERT[128:], "mixed"), (INSERT[:150], "low_quality"),
    ],
)
def test_verdicts(read, verdict):
    from collections import namedtuple

    row = namedtuple("Row", "file well clone_id sequence start end insert context")("f", "A01", "c1", read, 0, len(read), INSERT, "")
    panel = [("c1", INSERT), ("c2", OTHER)]
    assert sequencing._one(row, panel)[3] == verdict
    # within flanks the same is said, and of the same places
    flanks = ["".join(random.Random(seed).choices("ACGT", k=80)) for seed in (17, 18)]
    names = [f.split()[0] for f in sequencing._CALL.split(", ")]
    wide = row._replace(context=flanks[0] + INSERT + flanks[1])
    bare, whole = (dict(zip(names, sequencing._one(x, panel), strict=True)) for x in (row, wide))
    assert whole == bare
    if verdict == "exact" and read == INSERT:
        # what lies in the flanks is the vector's; a read of the vector alone has no insert
        marred = flanks[0][:60] + ("A" if flanks[0][60] != "A" else "C") + flanks[0][61:] + INSERT + flanks[1]
        call = dict(zip(names, sequencing._one(wide._replace(sequence=marred, end=len(marred)), panel), strict=True))
        assert (call["verdict"], call["n_differences"], call["coverage"]) == ("exact", 0, 1.0) and call["identity"] < 1
        assert sequencing._one(wide._replace(sequence=flanks[0], end=80), panel)[3] == "no_insert"
        # a share of both: the runner-up is named, and lowers the confidence
        chimera = INSERT + OTHER[:100]
        call = dict(zip(names, sequencing._one(row._replace(sequence=chimera, end=400), panel), strict=True))
        assert (call["matched"], call["runner_up"], call["confidence"]) == ("c1", "c2", round(1 - 89 / 289, 3))


def test_protein_changes():
    assert sequencing._protein_changes("ATGAAATAA", "ATGAACTAA") == ["K2N"]
    assert sequencing._protein_changes("ATGAAATAA", "ATGAAATAC") == ["length 2->3"]
    assert sequencing._protein_changes("ATGAAATAA", "ATGAAGTGA") == []


def test_gotoh_is_optimal():
    """Against all alignments of short sequences; gaps of both kinds are never neighbours."""
    rng = random.Random(1)

    def score(top, bottom, m):
        i = j = 0
        total, last = 0.0, None
        for r, q in zip(top, bottom, strict=True):
            if "-" not in (r, q):
                total, last, i, j = total + float(gotoh.scores(r, q)[0, 0]), 0, i + 1, j + 1
            elif q == "-":
                total, last, i = total + (0 if j in (0, m) else -1 if last == 1 else -11), 1, i + 1
            else:
                total, last, j = total + (-1 if last == 2 else -11), 2, j + 1
        return total

    def every(r, q, t="", b=""):
        if len(t) > 1 and ((t[-1] == "-" and b[-2] == "-") or (b[-1] == "-" and t[-2] == "-")):
            return
        if not r and not q:
            yield t, b
        if r and q:
            yield from every(r[1:], q[1:], t + r[0], b + q[0])
        if r:
            yield from every(r[1:], q, t + r[0], b + "-")
        if q:
            yield from every(r, q[1:], t + "-", b + q[0])

    for _ in range(40):
        r, q = ("".join(rng.choice("ACW") for _ in range(rng.randrange(1, 5))) for _ in range(2))
        got = gotoh.align_pair(r, q)
        assert score(*got, len(q)) == pytest.approx(max(score(t, b, len(q)) for t, b in every(r, q)))


def test_columns_hold_every_sequence():
    rng = random.Random(4)
    ref = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(40))
    seqs = [ref, ref[:20] + "WWW" + ref[20:], ref[5:], ref[:30] + ref[33:]]
    top, laid, columns = gotoh.build_columns(ref, seqs)
    assert top.replace("-", "") == ref and [x.replace("-", "") for x in laid] == seqs
    assert len({len(top), len(columns), *map(len, laid)}) == 1


def test_codons_round_trip():
    rng = random.Random(5)
    for _ in range(20):
        protein = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(90))
        made = codon.optimize(protein, ("BsaI", "BbsI"))
        assert local.translate(made.dna) == protein and not made.problems
    assert codon.optimize("MXM").problems


def test_refusals(spark):
    samples = spark.createDataFrame([("A1", "x"), ("C1", "y")], "well string, sample_name string")
    with pytest.raises(ValueError, match="contiguous"):
        forms.order(samples, "genewiz")
    with pytest.raises(ValueError, match="other characters"):
        forms.order(samples.withColumn("sample_name", F.lit("a b")), "elim")
    transfers = spark.createDataFrame([("A1", "B2", 5.0, 1)], "source_well string, dest_well string, volume_ul double, ordinal int")
    with pytest.raises(ValueError, match="not verified"):
        worklists.emit(transfers, "tecan_evo")
    with pytest.raises(NotImplementedError):
        worklists.emit(transfers, "hamilton_venus")
    lines = [r["line"] for r in worklists.emit(transfers, "tecan_evo", allow_unverified=True).orderBy("ordinal", "sub").collect()]
    assert lines == ["A;Source;;;1;;5.00;;;;", "D;Destination;;;10;;5.00;;;;", "W1;"]
    registry = Registry("thing")
    registry.register("a")(1)
    with pytest.raises(ValueError):
        registry.register("a")(2)


def test_vector_checks():
    assert construct.Vector("v", "AAAA" + "GATC", "GATC" + "AAAA").check_fusion_sites()
    assert not construct.Vector("v", "TTTTATCC", "TCTAGGGG").check_fusion_sites()


def test_store(spark, tmp_path):
    from pyspark.sql import types as T

    from sparkwell.operators import store

    path = f"{tmp_path}/t"
    assert not store.exists(spark, path)
    store.append(spark.createDataFrame([("a", 1), ("b", 1)], "seq_id string, v int"), path, "seq_id")
    store.append(spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "seq_id string, v int"), path, "seq_id")
    assert rows(store.read(spark, path)) == [("a", 1), ("b", 1), ("c", 2)] and rows(store.read(spark, path, ["seq_id"], v=2)) == [("c",)]
    store.refresh(spark.createDataFrame([("a", 9)], "seq_id string, v int"), path, f"{tmp_path}/u", "seq_id")
    assert rows(store.read(spark, f"{tmp_path}/u")) == [("a", 9), ("b", 1), ("c", 2)]
    assert store.info(spark, path).first()["rows"] == 3
    assert store.evolve(store.read(spark, path), T.StructType.fromDDL("seq_id string, new double, v string")).columns == ["seq_id", "new", "v"]


def test_texts(spark):
    from sparkwell.sinks import alignments, orders

    assert alignments.as_blocks([("ref", "AC-GT"), ("x", "AC-GA"), ("y", "-CTGT")], 3) == "ref              AC-\nx                ..-\ny                -.T\n\nref              GT\nx                .A\ny                ..\n"
    frame = spark.createDataFrame([("a", "ACGT")], "insert_name string, order_dna_seq string")
    assert tuple(orders.emit(frame, "generic").first()) == ("a", "ACGT", 4, 0.5)
    assert tuple(orders.summary(frame, "idt_eblocks").first()) == (1, 4, 1, 1)
    wells_ = spark.createDataFrame([("A1", "c1", "acgt", 1), ("a01", "c2", "ttt", 2)], "well string, clone_id string, insert_dna_seq string, ordinal int")
    assert [tuple(r)[:3] for r in sequencing.expectations_from(wells_).collect()] == [("A01", "c2", "TTT")]
