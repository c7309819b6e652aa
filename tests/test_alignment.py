"""Anchored alignments against whole tables, changes, and the consensus of germlines."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkwell.kernels import anchored, gotoh
from sparkwell.operators import alignment

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def changed(rng, letters, rate, gaps):
    out = []
    for c in letters:
        r = rng.random()
        if r < rate:
            out.append(rng.choice(RESIDUES))
        elif r < rate + gaps:
            continue
        else:
            out.append(c)
            if r < rate + 2 * gaps:
                out += [rng.choice(RESIDUES) for _ in range(rng.randint(1, 12))]
    return "".join(out)


def word(rng, n, letters=RESIDUES):
    return "".join(rng.choice(letters) for _ in range(n))


def short_pairs(rng):
    for k in range(300):
        n = rng.choice([0, 1, 2, 5, 30, 120, 300])
        ref = word(rng, n, RESIDUES if k % 3 else "AG")
        yield ref, [lambda r: changed(rng, r, 0.1, 0.02), lambda r: word(rng, rng.randint(0, 150), RESIDUES + "XB*Zé-"), lambda r: changed(rng, r[n // 3 :][:200], 0.05, 0.01), lambda r: r[:40] * 3, lambda r: ""][k % 5](ref)


def long_pairs(rng):
    for k in range(40):
        ref = word(rng, rng.randint(600, 2000))
        seq = changed(rng, ref, rng.choice([0, 0.002, 0.01, 0.05]), rng.choice([0, 0.0005, 0.002]))
        if k % 4 == 0:
            seq = seq[rng.randint(0, 100) : -rng.randint(1, 200)]
        if k % 7 == 0:
            seq = word(rng, 30) + seq + word(rng, 40)
        yield (ref + ref[:200] if k % 11 == 0 else word(rng, 80) * 12 if k % 13 == 0 else ref), seq


@pytest.mark.parametrize("pairs", [short_pairs, long_pairs])
def test_as_the_whole_table(pairs, monkeypatch):
    refs, seqs = zip(*pairs(random.Random(7)), strict=True)
    got, whole = anchored.align(refs, seqs)
    for ref, seq, where in zip(refs, seqs, got, strict=True):
        assert np.array_equal(where, gotoh.slots(ref, seq))
    if pairs is long_pairs:
        assert whole < len(refs) * 0.7
        monkeypatch.setattr(anchored, "KEPT_BYTES", 1000)  # the way back is found from kept steps
        again, _ = anchored.align(refs[:6], seqs[:6])
        assert all(np.array_equal(a, b) for a, b in zip(again, got, strict=False))


def test_long_pairs_of_little_loss_need_no_table():
    rng = random.Random(3)
    ref = word(rng, 20_000)
    seq = ref[:5000] + word(rng, 7) + ref[5000:12_000] + ref[12_011:]
    (where,), whole = anchored.align([ref], [seq])
    assert whole == 0 and where[0] == 1 and where[-1] == 2 * len(ref) - 1 and (np.diff(where) >= 0).all()
    inserted = np.flatnonzero(where % 2 == 0)
    assert len(inserted) == 7 and len(set(where[inserted])) == 1
    assert anchored.anchors(anchored.encode(word(rng, 500)), anchored.encode(word(rng, 500))) is None


def test_a_shifted_copy_is_not_taken_for_the_chain():
    """A path off the chain's diagonals that scores more than the chain must be found."""
    rng = random.Random(5)
    unit = word(rng, 400)
    damaged = "".join(c if i % 9 else "W" for i, c in enumerate(unit))
    ref, seq = unit + word(rng, 50) + damaged, damaged
    (where,), _ = anchored.align([ref], [seq])
    assert np.array_equal(where, gotoh.slots(ref, seq))


def test_changes(spark):
    rows = [("a", "ACDEFGHIKL", "ACDEFGHIKL"), ("b", "ACDEFGHIKL", "ACWEFGHIKL"), ("b", "ACDEFGHIKL", "ACWEFGHIKL"), ("c", "ACDEFGHIKLMNPQRSTVWY", "ACDEFGHILMNPQRSTVWY"), ("d", "ACD", ""), ("e", "", "ACD"), ("f", None, "A"), ("g", "A", None), (None, "AC", "AD")]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], "seq_id string, germline_aa string, aa_seq string, number int, observed string")
    got = sorted((tuple(r) for r in alignment.germline_changes(frame).collect()), key=str)
    want = [("b", 3, "D", "W")] * 2 + [("c", 9, "K", "-"), ("d", 1, "A", "-"), ("d", 2, "C", "-"), ("d", 3, "D", "-"), (None, 2, "C", "D")]
    assert got == sorted(want, key=str)
    assert alignment.germline_changes(frame.limit(0)).count() == 0
    pool = spark.createDataFrame([("a", "G", "ACWEF"), ("b", "H", "ACD"), ("c", None, "A")], "seq_id string, v_gene string, aa_seq string")
    refs = spark.createDataFrame([("G", "ACDEF"), ("I", "A")], "v_gene string, germline_aa string")
    assert [tuple(r) for r in alignment.pairwise_to_germline(pool, refs).collect()] == [("a", "ACDEF", "ACWEF")]
    assert [tuple(r) for r in alignment.differences(alignment.pairwise_to_germline(pool, refs)).collect()] == [tuple(r) for r in alignment.germline_changes(alignment.with_germline(pool, refs)).collect()]


def test_consensus_by_hand(spark):
    whole = "EVQLLESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSA"
    allele = whole[:20] + "K" + whole[21:]
    rows = [("G", whole)] * 9 + [("G", allele), ("G", allele[3:]), ("G", allele[:-4].lower() + "..-"), ("G", None), ("G", "  "), ("G", "---")]
    rows += [("H", "ACDEFGHIKLMNPQRSTVWYACDEF"), ("H", "ACDEFGHIKLANPQRSTVWYACDEF"), (None, "AC"), ("I", "a.c")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "v_gene string, germline_aa string, votes int")
    got = {r["v_gene"]: (r["germline_aa"], r["votes"]) for r in alignment.consensus_germline(frame).collect()}
    # nine reads of one germline are one germline: its three alleles outvote it; ties of H go to the least residue
    assert got == {"G": (allele, 4), "H": ("ACDEFGHIKLANPQRSTVWYACDEF", 2), "I": ("AC", 1)}
    assert {r["v_gene"] for r in alignment.consensus_germline(frame, min_support=3).collect()} == {"G"}
    assert alignment.consensus_germline(frame.limit(0)).count() == 0


def test_votes_follow_insertions_and_deletions(spark):
    base = "ACDEFGHIKLMNPQRSTVWY" * 3
    shorter, longer = base[:30] + base[31:], base[:30] + "WWW" + base[30:]
    frame = spark.createDataFrame([("G", base), ("G", shorter), ("G", longer)], "v_gene string, germline_aa string")
    votes = {(r["place"], r["residue"]): r["votes"] for r in alignment.column_votes(frame).collect()}
    assert {k[0] for k in votes} == set(range(len(longer))) and all(votes[i, longer[i]] == 3 for i in range(30))
    assert sum(votes.values()) == sum(map(len, (base, shorter, longer)))


def test_screen_of_both_strands(spark, monkeypatch):
    from sparkwell.operators import sequencing

    rng = random.Random(12)
    turn = str.maketrans("ACGT", "TGCA")
    refs = [(f"r{i:02}", word(rng, 80, "ACGT") + ("A" * 30 if i % 3 == 0 else "")) for i in range(12)]
    reads = [(f"q{i:02}", refs[i % 12][1][5:70] + "N" + word(rng, 20, "ACGT") if i % 2 else refs[i % 12][1][::-1].translate(turn)) for i in range(30)]
    reads += [(f"a{i:02}", "A" * 40 + word(rng, 30, "ACGT")) for i in range(6)] + [("e", ""), ("n", "N" * 30), ("p", "ACGTACGTACGTACGT" * 2)]
    kmers = lambda s: {s[i : i + 12] for i in range(len(s) - 11) if "N" not in s[i : i + 12]}
    want = {}
    for name, seq in reads:
        found = []
        for ref, other in refs:
            plus, minus = len(kmers(seq) & kmers(other)), len(kmers(seq[::-1].translate(turn)) & kmers(other))
            if plus or minus:
                found.append((-max(plus, minus), ref, "+" if plus >= minus else "-"))
        want |= {(name, p): (r, -n, s) for p, (n, r, s) in enumerate(sorted(found)[:3], 1)}
    q, r = spark.createDataFrame(reads, "read_id string, seq string"), spark.createDataFrame(refs, "ref_id string, seq string")
    told = lambda: {(x["read_id"], x["place"]): (x["ref_id"], x["shared"], x["strand"]) for x in sequencing.screen(q, r).collect()}
    assert told() == want
    monkeypatch.setattr(sequencing, "MAX_KMERS", 10)
    assert told() == want
    monkeypatch.setattr(sequencing, "HOT_SHARE", 10**9)
    monkeypatch.setattr(sequencing, "HOT_ROWS", 3)  # some k-mers are hot now
    assert told() == want


def test_a_panel_beyond_one_plate(spark, monkeypatch):
    from sparkwell.operators import sequencing

    rng = random.Random(13)
    clones = [(f"c{i}", word(rng, 240, "ACGT")) for i in range(6)]
    rows = [(f"f{i}", f"{'ABCDEF'[i % 6]}01", clones[i % 6][0], clones[(i + (i == 4)) % 6][1][: 240 - i], clones[i % 6][1]) for i in range(12)]
    traces = spark.createDataFrame([(f, w, c, s, 0, len(s), insert, "") for f, w, c, s, insert in rows], "file string, well string, clone_id string, sequence string, start int, end int, insert string, context string")
    want = sorted(map(str, sequencing.call_traces(traces, clones).collect()))
    near = sequencing.screen(traces.select(traces.file.alias("read_id"), traces.sequence.alias("seq")), spark.createDataFrame(clones, "ref_id string, seq string")).collect()
    others = {}
    for r in near:
        others.setdefault(r["read_id"], []).append((r["place"], r["ref_id"], dict(clones)[r["ref_id"]]))
    brought = traces.join(spark.createDataFrame([(f, sorted(o)) for f, o in others.items()], "file string, others array<struct<place:bigint,clone_id:string,insert:string>>"), "file", "left")
    assert sorted(map(str, sequencing.call_traces(brought, None).collect())) == want and any("wrong_clone" in w for w in want)


def test_a_read_found_whole_is_aligned_as_by_the_table():
    from sparkwell.kernels import local

    rng = random.Random(3)
    for _ in range(40):
        reference = word(rng, 200, "ACGT")
        at, n = rng.randrange(120), rng.randrange(12, 80)
        query = reference[at : at + n]
        offset, spread = local.diagonal(query, reference)
        assert local.align_to(reference, query) == local.align(reference, query, offset, max(local.MIN_BAND, spread + local.MIN_BAND))
    twice = word(rng, 40, "ACGT")
    assert local.align_to(twice + twice, twice) is None  # no k-mer stands once
    assert local.shared_kmers(twice, [twice, local.complement_of(twice), "A" * 30], 12) == [(29, False), (29, True), (0, False)]


def test_consensus_moves_what_differs(spark):
    """Germlines that are alike give a row for each column that differs and one for the gene, however long they are; before, one for each residue."""
    rng = random.Random(5)
    whole = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(3000))
    other = whole[:1000] + ("A" if whole[1000] != "A" else "C") + whole[1001:]
    frame = spark.createDataFrame([("G", whole), ("G", other), ("G", other), ("G", whole[5:]), ("H", "XX*B")], "v_gene string, germline_aa string").repartition(3)
    anchors, votes = alignment._changed_columns(frame, "germline_aa")
    assert votes.count() == 2 + 1 + 5
    assert {tuple(r) for r in alignment.consensus_germline(frame).collect()} == {("G", whole, 3), ("H", "XX*B", 1)}
    assert alignment.column_votes(frame).where("v_gene = 'G'").count() == 3001


def test_repeats_take_a_band():
    """Sequences that repeat one line have no anchors; a band that provably suffices gives the slots of the whole table, and few cells."""
    rng = random.Random(8)
    for _ in range(60):
        line = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice((2, 3, 7, 40, 95))))
        ref = (line * 400)[: rng.randrange(300, 900)]
        seq = list(ref)
        for _ in range(rng.randrange(4)):
            seq[rng.randrange(len(seq))] = rng.choice("ACDEFGHIKLMNPQRSTVWYX")
        kind = rng.randrange(5)
        seq = "".join(seq[20:] if kind == 0 else seq[:-15] if kind == 1 else seq[:100] + seq[101:] if kind == 2 else seq[:50] + ["W"] + seq[50:] if kind == 3 else seq)
        assert anchored.align([ref], [seq])[0][0].tolist() == gotoh.slots(ref, seq).tolist(), (ref, seq)
    ref = "RETINLY" * 900
    seq = "".join("W" if i % 1009 == 150 else c for i, c in enumerate(ref))
    assert anchored.align([ref], [seq])[1] == 0
    part = anchored.Part(anchored.encode(ref), anchored.encode(seq), 0, 0, 0, True, True)
    low, high = anchored.band(part)
    assert high - low < 100


def test_equal_reads_are_judged_once(monkeypatch):
    """Before, each of equal reads was aligned anew."""
    from types import SimpleNamespace

    from sparkwell.operators import sequencing

    rng = random.Random(3)
    insert, other = ("".join(rng.choice("ACGT") for _ in range(240)) for _ in range(2))
    changed = insert[:100] + ("A" if insert[100] != "A" else "C") + insert[101:]
    kinds = [(changed, "A", insert), (changed.lower(), "A", insert), (changed, "B", other), (insert, "A", insert), (insert, "A", None), (insert, None, float("nan")), (insert[:40], "A", insert)]
    rows = [SimpleNamespace(file=str(i), well=f"A{i % 12}", clone_id=c, sequence=s, start=0, end=len(s), insert=x, context="") for i, (s, c, x) in enumerate(kinds * 20)]
    panel, wide = [("A", insert), ("B", other)], [("A", insert)]
    others = [panel if i % 2 else wide for i in range(len(rows))]
    want = [sequencing._one(r, p) for r, p in zip(rows, others, strict=True)]
    seen = []
    one = sequencing._one
    monkeypatch.setattr(sequencing, "_one", lambda row, p: seen.append(row) or one(row, p))
    got = sequencing._all(iter(rows), others)
    assert list(map(str, got)) == list(map(str, want)) and len(seen) == 12


def test_one_strand_screen_cuts_only_likely_kmers(spark, monkeypatch):
    """The same rows with and without the table, letters of any case and script included; before, every k-mer of a read was a row."""
    from sparkwell.operators import screen

    rng = random.Random(4)
    alphabet = "acgtACGTN \u00e9\u00df\u0130\u03c3\U00010400"
    refs = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(6)] + ["short", None, "the quick brown fox"]
    reads = [refs[i % 6][5:40].swapcase() + "".join(rng.choice(alphabet) for _ in range(50)) for i in range(40)] + [None, "", "THE QUICK brown dog"]
    known = spark.createDataFrame(list(enumerate(refs)), "ref_id int, seq string")
    rows = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = sorted(map(tuple, screen.screen_one_strand(rows, known).collect()))
    monkeypatch.setattr(screen, "MAX_KMERS", 0)
    assert got == sorted(map(tuple, screen.screen_one_strand(rows, known).collect())) and len(got) > 20
    plain = "".join(rng.choice("acgt ") for _ in range(5000))
    import pyarrow as pa

    cut = list(screen._likely([plain[100:112].upper()], 12)(iter([pa.RecordBatch.from_pydict({"read_id": [1], "seq": [plain]})])))
    assert 1 <= sum(len(c) for c in cut) <= 10


def test_short_numbers_equal_long_ones(monkeypatch):
    """Two bytes for a cell, also over more letters than two bytes count and with the way back in blocks."""
    rng = np.random.default_rng(11)
    parts = [anchored.Part(*(rng.integers(0, 20, n).astype(np.uint8) for n in (60 + k, size)), k, 0, 0, k < 2, k < 2) for k, size in enumerate((36_000, 500, 90, 40))]
    batch = anchored._Batch(parts)
    assert batch.start().dtype == np.int16
    got = batch.slots()
    monkeypatch.setattr(anchored, "SHORT", 0)
    monkeypatch.setattr(anchored, "KEPT_BYTES", 1 << 20)
    batch = anchored._Batch(parts)
    assert batch.start().dtype == np.int32
    assert all((a == b).all() for a, b in zip(got, batch.slots(), strict=True))


def test_pairs_of_one_reference_are_swept(monkeypatch):
    """All along antidiagonals, not one after the other in the old batches; also with short numbers or long ones, few kept steps and tables, and sequences that leave early."""
    from sparkwell.kernels import sweep

    rng = random.Random(12)
    ref = word(rng, 500)
    seqs = [word(rng, rng.choice((1, 3, 60, 499, 500, 501, 900, 2500))) for _ in range(60)] + [changed(rng, ref[100:], 0.3, 0.1) for _ in range(10)] + ["AC" * 300, ref[:7]]
    want = [gotoh.slots(ref, s).tolist() for s in seqs]
    codes = anchored.encode(ref)
    held = [anchored.Part(codes, anchored.encode(s), k, 0, 0, k % 2 == 0, k % 3 == 0) for k, s in enumerate(seqs)]
    ends = [anchored._Batch([p]).slots()[0].tolist() for p in held]
    monkeypatch.setattr(anchored, "_Batch", None)
    got, whole = anchored.align([ref] * len(seqs), seqs)
    assert [w.tolist() for w in got] == want and whole > 50
    for values in ({"LEAST_STEPS": 8, "STRETCH": 20, "CELLS": 3000}, {"LOW": -1000, "TOGETHER": 5}, {"KEPT": 1 << 16}):
        for k, v in values.items():
            monkeypatch.setattr(sweep, k, v)
        assert [w.tolist() for w in sweep.slots(anchored._SWEEP, codes, [anchored.encode(s) for s in seqs])] == want
        for p, w in zip(held, ends, strict=True):
            assert sweep.slots(anchored._SWEEP, codes, [p.seq], p.free_start, p.free_end)[0].tolist() == w


def test_changes_are_handed_on_in_parts(monkeypatch):
    """Before, all changes of a batch were one batch, some thousand times as long; letters of any script are kept."""
    import pyarrow as pa

    rows = [(f"s{k}", "ACDEFé\U00010400", ("", "ACWEFé\U00010400", "ACDEFe")[k % 3]) for k in range(30)]
    monkeypatch.setattr(alignment, "MOST_CHANGES", 20)
    parts = list(alignment._changed(iter([pa.RecordBatch.from_pydict(dict(zip(("seq_id", "germline_aa", "aa_seq"), map(list, zip(*rows)), strict=True)))])))
    assert len(parts) > 3 and max(map(len, parts)) <= 28
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = []
    for name, ref, seq in rows:
        top, bottom = gotoh.align_pair(ref, seq)
        on = [(a, b) for a, b in zip(top, bottom, strict=True) if a != "-"]
        want += [(name, i + 1, a, b) for i, (a, b) in enumerate(on) if a != b]
    assert got == want


def test_bands_are_stepped_through_together():
    """Pairs of a band, some at a time, give the slots of their whole tables; before, each was stepped through by itself, row by row."""
    from sparkwell.kernels import sweep

    rng = random.Random(17)
    bands, want = [], []
    for k in range(60):
        ref = word(rng, rng.choice((7, 20, 90, 200)), RESIDUES if k % 3 else "AC")
        seq = changed(rng, ref, 0.05, 0.02) or "A"
        start, end = k % 2 == 0, k % 5 < 3
        where = anchored._Batch([anchored.Part(anchored.encode(ref), anchored.encode(seq), 0, 0, 0, start, end)]).slots()[0]
        passed = [0, len(ref) - len(seq)]
        for j, s in enumerate(where.tolist()):
            passed += [(s + 1) // 2 - j - 1, s // 2 - j, (s + 1) // 2 - j]
        bands.append(sweep.Band(anchored.encode(ref), anchored.encode(seq), min(passed) - k % 3, max(passed) + k % 4, start, end))
        want.append(where.tolist())
    assert [w.tolist() for w in sweep.banded(anchored._SWEEP, bands)] == want
    assert [sweep.banded(anchored._SWEEP, [b])[0].tolist() for b in bands] == want


def test_a_part_of_the_reference_needs_no_chain(monkeypatch):
    """A sequence that is one place of the reference lies there, others are aligned as before."""
    rng = random.Random(18)
    ref = word(rng, 400) + "ACD" * 200
    seqs = [ref, ref[20:], ref[7:90], "ACD" * 150, "XX" + ref[10:], ref[:100].lower()]
    assert [w.tolist() for w in anchored.align([ref] * 6, seqs)[0]] == [gotoh.slots(ref, s).tolist() for s in seqs]
    monkeypatch.setattr(anchored, "_chained", None)
    assert anchored.align([ref] * 3, seqs[:3])[1] == 0


def test_germlines_are_made_once(spark):
    """Before, the rows of a consensus were made four times: for their size, for the anchors twice, and for the alignment."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("G", "ACDEFGHIKL"), ("G", "ACDEFGHIK"), ("G", "ACWEFGHIKL"), ("H", "AC-D"), ("H", " "), (None, "A")], "v_gene string, germline_aa string")
    got = alignment.consensus_germline(rows.mapInArrow(counted, rows.schema)).collect()
    assert {tuple(r) for r in got} == {("G", "ACDEFGHIKL", 3), ("H", "ACD", 1)}
    assert made.value == 6


def test_pairs_are_aligned_in_parts(monkeypatch):
    """Before, the slots of a whole batch of up to 10,000 pairs were held at once."""
    import pyarrow as pa

    sizes, align = [], anchored.align
    monkeypatch.setattr(alignment, "MOST_PAIRS", 7)
    monkeypatch.setattr(anchored, "align", lambda refs, seqs: sizes.append(len(refs)) or align(refs, seqs))
    batch = pa.RecordBatch.from_pydict({"seq_id": [str(k) for k in range(20)], "germline_aa": ["ACD"] * 20, "aa_seq": ["AC"] * 20})
    assert sum(len(b) for b in alignment._changed(iter([batch]))) == 20 and sizes == [7, 7, 6]


def test_residues_of_odd_texts(spark):
    """One pass over a text gives what the two of the SQL give."""
    from pyspark.sql import functions as F

    from sparkwell.plans import derive

    odd = ["", "Ünïcödé ıİſK straße", "abcdefghijklmnopqrstuvwxyz ABCXYZ 019_-\n\t", "BJOUXZ bjouxz", "\U0001d400AİiKK", None]
    frame = spark.createDataFrame([(t,) for t in odd], "text string")
    plain = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    assert all(a == b for a, b in frame.select(derive.protein(), plain).collect())
