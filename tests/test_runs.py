"""Stores, references, vectors, whole runs, workbooks; and operators against plain loops."""

from __future__ import annotations

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.functions.dna import CODONS
from sparkwell.kernels import gotoh, greedy
from sparkwell.operators import alignment, assign, classify, construct, hits, ledger, plates, reference, runs, selection, sequencing, simulate, stores
from sparkwell.sources import grids, repertoire, workbooks

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


# ---------------------------------------------------------------- ledger


def test_ancestors_of_a_long_chain(spark):
    """Beyond any fixed number of rounds; cycles, and what hangs on them, have no root."""
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 300), (400, 400), (500, 999), (601, 602), (602, 603), (603, 604), (604, 601)]
    got = {r["obj_id"]: (r["root"], r["depth"]) for r in ledger.doubled_ancestors(spark.createDataFrame(rows, "obj_id long, parent_id long")).collect()}
    assert got == {**{i: (0, i) for i in range(200)}, **{i: (None, None) for i in (300, 301, 302, 303, 601, 602, 603, 604)}, 400: (400, 0), 500: (500, 0)}


def test_lineage_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1, "made") for i in range(70)] + [(70, 0, "odd")], "parent_id long, child_id long, relationship string")
    start = spark.createDataFrame([(70,)], "obj_id long")
    assert {r["obj_id"]: r["depth"] for r in ledger.lineage(links, start).collect()} == {70 - k: k for k in range(1, 71)}
    assert ledger.lineage(links, start, levels=3).count() == 3
    assert ledger.lineage(links, start, "down", levels=1).collect()[0]["obj_id"] == 0
    assert {r["parent_id"] for r in ledger.parents(links, start).collect()} == {69} and {r["child_id"] for r in ledger.children(links, start).collect()} == {0}
    art = spark.createDataFrame([("a", "x")], "obj_id string, label string")
    assert ledger.get(art, "a")["label"] == "x"
    with pytest.raises(KeyError):
        ledger.get(art, "b")


def test_wells_through_many_plates(spark):
    chain = spark.createDataFrame([(f"p{i}", "A01", f"p{i - 1}", "A01") for i in range(1, 40)], "plate_id string, well string, source_plate_id string, source_well string")
    assert plates.trace_wells(chain, chain.where("plate_id = 'p39'")).agg(F.max("depth")).first()[0] == 39


# ---------------------------------------------------------------- assignments


def test_many_names_are_matched_alike(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 7))) for _ in range(60)] + ["", "ABcd", "é漢"]
    names = spark.createDataFrame([(w, f"P{i}") for i, w in enumerate(words)], "word string, plate_id string")
    texts = ["".join(rng.choices("abcdABCD ", k=rng.randrange(0, 40))) for _ in range(40)] + ["", None, "x é漢 y", "ABCD"]
    frame = spark.createDataFrame(list(enumerate(texts)), "grid_id long, text string")
    want = {(i, w, f"P{k}") for i, t in enumerate(texts) for k, w in enumerate(words) if t is not None and w and w.lower() in t.lower()}
    for most in (1000, 3):
        monkeypatch.setattr(assign, "MAX_NAMES", most)
        assert {tuple(r) for r in assign.mentions(frame, names).collect()} == want


def test_words_of_plate_kinds(spark):
    texts = {"HLA plate": "control", "ctrl": "control", "Negative": "control", "irrelevant": "control", "experimental run": "target", "Expt 4": "target", "test": "target", "test vs control": None, "nothing": None}
    frame = spark.createDataFrame([(t, t) for t in texts], "grid_id string, text string")
    assert {r["grid_id"]: r["plate_kind"] for r in assign.kind_from_text(frame).collect()} == texts


# ---------------------------------------------------------------- stores

SCHEMA = """
CREATE TABLE IF NOT EXISTS things (
  thing_id TEXT PRIMARY KEY,  -- one of a, b, or c
  size REAL NOT NULL DEFAULT 0.0, kind VARCHAR(20) CHECK (kind IN ('x', 'y')), -- not, a column
  UNIQUE (size, kind)
);
create table pairs (a INTEGER, b INTEGER, PRIMARY KEY (a, b), FOREIGN KEY (a) REFERENCES things (thing_id));
"""


def test_declarations():
    assert {t: list(c) for t, c in stores.declared_columns(SCHEMA).items()} == {"things": ["thing_id", "size", "kind"], "pairs": ["a", "b"]}
    assert stores.declared_keys(SCHEMA) == {"things": ["thing_id"], "pairs": ["a", "b"]}
    assert stores.strip_comments("a -- b\nc") == "a \nc"


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "STORES", dict(stores.STORES))
    spec = stores.register_store("shed", SCHEMA, "things and pairs")
    with pytest.raises(ValueError):
        stores.register_store("shed", SCHEMA)
    with pytest.raises(KeyError):
        stores.connect(spark, "barn")
    assert spec.tables["things"].simpleString() == "struct<thing_id:string,size:double,kind:string>"
    shed = stores.connect(spark, "shed", str(tmp_path))
    assert shed.table("things").count() == 0 and shed.migrate("things") == []
    rows = lambda *r: spark.createDataFrame(list(r), "thing_id string, size double")
    shed.put("things", rows(("a", 1.0), ("b", 2.0)))
    shed.put("things", rows(("b", 3.0)).withColumn("kind", F.lit("x")))
    assert sorted(tuple(r) for r in shed.table("things").collect()) == [("a", 1.0, None), ("b", 3.0, "x")]
    with pytest.raises(KeyError):
        shed.put("things", rows(("a", 1.0)).withColumn("colour", F.lit("red")))
    stores.STORES.pop("shed")
    stores.register_store("shed", SCHEMA.replace("size REAL", "weight REAL, size REAL"))
    later = stores.connect(spark, "shed", str(tmp_path))
    assert later.migrate("things") == ["weight"] and later.table("things").where("weight IS NULL").count() == 2
    shed.put("pairs", spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a long, b long"))
    assert stores.attach(later, "s") == ["s_things", "s_pairs"]
    assert spark.sql("SELECT count(*) FROM s_things JOIN s_pairs ON size = b").first()[0] == 1


def test_roots(monkeypatch, tmp_path):
    monkeypatch.setenv(stores.ROOT_VARIABLE, "/somewhere")
    assert stores.data_root() == "/somewhere"
    monkeypatch.delenv(stores.ROOT_VARIABLE)
    monkeypatch.chdir(tmp_path)
    assert stores.data_root() == str(tmp_path / "data") and stores.data_root("x") == "x"
    assert stores.code_version(tmp_path) == "unknown"
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.py").write_text("x = 1")
    assert stores.code_version(tmp_path / "one") == stores.code_version(tmp_path / "two") != stores.code_version()
    (tmp_path / "two" / "a.py").write_text("x = 2")
    assert stores.code_version(tmp_path / "one") != stores.code_version(tmp_path / "two")


def test_plate_round_trip(spark, tmp_path):
    store = stores.connect(spark, "assay", str(tmp_path))
    wells = plates.blank_plate(spark, "PLT-1", 24).drop("place_down")
    head = {"plate_id": "PLT-1", "barcode": "BC", "format": 24, "content_kind": "dna", "is_virtual": False, "created_at": "2020"}
    assert stores.save_plate(store, head, wells) == "PLT-1"
    stores.save_plate(store, head | {"plate_id": "PLT-2", "content_kind": "culture", "created_at": "2021"}, wells)
    stores.save_plate(store, head | {"notes": "again"}, wells.where("well = 'B02'").withColumn("clone_id", F.lit("c1")))
    found, kept = stores.load_plate(store, "PLT-1")
    assert found["notes"] == "again" and [r["well"] for r in kept.collect()][:5] == ["A01", "B01", "C01", "D01", "A02"]
    assert [r["clone_id"] for r in kept.where("clone_id IS NOT NULL").collect()] == ["c1"]
    assert [r["plate_id"] for r in stores.find_plates(store.table("plates"), barcode="BC").collect()] == ["PLT-1", "PLT-2"]
    assert [r["plate_id"] for r in stores.find_plates(store.table("plates"), "culture").collect()] == ["PLT-2"]
    with pytest.raises(KeyError):
        stores.load_plate(store, "PLT-9")
    reads = spark.createDataFrame([("PLT-1", "b2", 1.5), ("PLT-1", "A1", 0.1)], "plate_id string, well string, od450 double")
    stores.save_reads(store, reads, "od450", units="OD", plate_format=24)
    stores.save_reads(store, reads.where("well = 'b2'").withColumn("od450", F.lit(2.5)), "od450", plate_format=24)
    got = plates.read_values(store.table("reads"), store.table("wells").select("plate_id", "well", "clone_id"), "od450").collect()
    assert {(r["well"], r["value"], r["clone_id"]) for r in got} == {("B02", 2.5, "c1"), ("A01", 0.1, None)}


# ---------------------------------------------------------------- references


def test_junctions_are_found_again():
    """150 reads of three genes, some with a changed cysteine: the block between the anchors holds the loop that the aligner never saw.

    A changed cysteine with nothing inserted before it can't be told from a
    borrowed residue: it counts to the junction then, which stays in its block.
    """
    rng = random.Random(17)
    numbers = [*range(1, 105), *range(118, 129)]
    right = 0
    for gene in range(3):
        ref = "".join(random.Random(gene).choices(LETTERS.replace("C", "").replace("W", ""), k=103)) + "C" + "WGQGTLVTVSS"
        reads, loops = [], []
        for k in range(50):
            v = list(ref[:104])
            for i in rng.sample(range(100), 5):
                v[i] = rng.choice(LETTERS)
            if k % 10 == 0:
                v[103] = rng.choice("YSFG")  # the cysteine changed
            loop = "".join(rng.choices(LETTERS.replace("C", "").replace("W", ""), k=rng.randrange(6, 24)))
            reads.append("".join(v) + loop + ref[104:])
            loops.append((loop, loop if v[103] == "C" else v[103] + loop))
        top, laid, columns = gotoh.build_columns(ref, reads, numbers)
        first, last = (next(i for i, c in enumerate(columns) if c == n) for n in (104, 105))
        right += sum(row[first + 1 : last].replace("-", "") in loop for row, loop in zip(laid, loops, strict=True))
        assert [x.replace("-", "") for x in laid] == reads and top.replace("-", "") == ref
        assert reference.region_columns(columns, numbers)[-2:] == [("CDR3", first + 1, last), ("FR4", last, len(columns))]
    assert right >= 149  # of one read the loop ends as the framework does, and as good an alignment puts it there


def test_junction_without_an_anchor():
    """A deleted anchor leaves its column empty: the residue that the aligner borrowed goes back to the junction."""
    where = gotoh.settled(np.array([1, 3, 4, 7]), "AXYW", "ACKW", 1, 3)
    assert where.tolist() == [1, 6, 6, 7]  # X stood on the cysteine's column, and is none
    assert gotoh.settled(np.array([1, 2, 2, 7]), "AXYW", "ACKW", 1, 3).tolist() == [1, 3, 6, 7]  # slid: X is the substitute
    assert gotoh.settled(np.array([1, 2, 3, 7]), "AXCW", "ACKW", 1, 3).tolist() == [1, 2, 3, 7]  # an insertion before an intact anchor stays
    assert gotoh.settled(np.array([1, 3, 6, 7]), "ACXY", "ACKW", 1, 3).tolist() == [1, 3, 6, 6]  # a foreign residue on the second anchor


def test_regions():
    numbers = [25, 26, 27, 104, 118, None]
    assert reference.regions_of(numbers) == [("FR1", 0, 2), ("CDR1", 2, 3), ("FR3", 3, 4), ("FR4", 4, 5)]
    assert reference.column_regions([None, 1, None, 4, None, 5, None, 6], [*numbers[:3], 104, 118, None]) == ["FR1", "FR1", "FR1", "FR3", "CDR3", "FR4", "FR4", None]
    assert reference.drop_loop("ACDE", [104, 105, None, 118]) == ("ADE", [104, None, 118])


def test_references_of_genes(spark):
    gapped = "A" * 100 + "..CD" + "EF" + "-" * 22  # positions 103, 104 and two of the loop
    table = spark.createDataFrame([("V", "H", "human", "IGHV1-2*02", "W" * 128), ("V", "H", "human", "IGHV1-2*01", gapped), ("J", "H", "human", "IGHJ4*01", "-" * 115 + "KK" + "WGQ" + "-" * 8)], "kind string, chain string, species string, allele string, gapped string")
    rows = spark.createDataFrame([("s1", "IGHV1-2", "IGHJ4", "GERM"), ("s2", "IGHV1-2", "IGHJ4", "GERM"), ("s3", "IGHV1-2", "IGHJ6", "OTHER"), ("s4", "IGHV9-9", None, "SEEN"), ("s5", "IGHV9-9", None, None)], "seq_id string, v_gene string, j_gene string, germline_aa string")
    got = {r["v_gene"]: r for r in reference.references_for(rows, table).collect()}
    one = got["IGHV1-2"]
    assert one["label"] == "IMGT IGHV1-2*01 + IGHJ4*01" and one["germline_aa"] == "A" * 100 + "CD" + "WGQ" and one["numbers"][-5:] == [103, 104, 118, 119, 120]
    assert (got["IGHV9-9"]["germline_aa"], got["IGHV9-9"]["numbers"], got["IGHV9-9"]["label"]) == ("SEEN", None, "germline consensus (n=1)")
    own = reference.references_for(rows, None, spark.createDataFrame([("IGHV9-9", "IGHV9-9*01", "FASTA")], "gene string, allele string, sequence string"))
    assert {r["v_gene"]: r["germline_aa"] for r in own.collect()} == {"IGHV9-9": "FASTA", "IGHV1-2": "OTGER"}  # columns of the longer one; ties go to the least residue
    reads = spark.createDataFrame([("s1", "IGHV1-2", "A" * 100 + "CDXXXXWGQ"), ("s2", "IGHV1-2", "A" * 100 + "CDXXWGQ")], "seq_id string, v_gene string, aa_seq string")
    msa = {r["seq_id"]: r for r in reference.build_msa(reads, reference.references_for(rows, table)).collect()}
    assert msa["s2"]["gapped"].endswith("CDX--XWGQ") and msa["s1"]["identity"] == 1.0 and msa["s1"]["n_columns"] == 109
    assert runs.alignment_summary(reference.build_msa(reads, reference.references_for(rows, table))).first()["insertion_columns"] == 4


def test_backends():
    assert reference.available_backends() == ["reference"]
    with pytest.raises(KeyError, match="unknown aligner"):
        gotoh.BACKENDS.get("mafft")



def test_download_once(spark, tmp_path):
    calls = []

    def opener(request, timeout):
        calls.append(request.full_url)
        return io.BytesIO(b">X|IGHV1-2*01|Homo sapiens|F|V-REGION|\nQVQ..L\n>Y|IGHV3-23*01|Homo sapiens|F|V-REGION|\nEVQ\n")

    genes = spark.createDataFrame([("IGHV1-2",)], "gene string")
    for _ in range(2):
        got = reference.from_url(spark, genes, "http://example.org/germlines.fasta", tmp_path, opener).collect()
    assert [(r["gene"], r["sequence"]) for r in got] == [("IGHV1-2", "QVQL")] and len(calls) == 1


# ---------------------------------------------------------------- selection against loops


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_farthest_by_hand():
    rng = random.Random(9)
    seqs = ["".join(rng.choices("ACDE", k=rng.randrange(3, 9))) for _ in range(30)]
    far = lambda a, b: edit(a, b) / max(len(a), len(b))
    order = [min(range(30), key=lambda i: hashlib.sha256(f"5:{seqs[i]}".encode()).digest())]
    while len(order) < 12:
        order.append(max((i for i in range(30) if i not in order), key=lambda i: (round(min(far(seqs[i], seqs[j]) for j in order), 9), -i)))
    assert greedy.farthest(seqs, 12, 5) == order
    line = greedy.seriate(seqs)
    assert sorted(line) == list(range(30))
    for k in range(1, 30):
        rest = line[k:]
        assert min(far(seqs[i], seqs[line[k - 1]]) for i in rest) == pytest.approx(far(seqs[line[k]], seqs[line[k - 1]]))


# ---------------------------------------------------------------- constructs

VECTOR = construct.vector_of(
    "two",
    (
        construct.Cassette("heavy", (construct.Element("promoter"), construct.Element("signal", "ATGGGATCC"), construct.Element("VH", kind="insert"), construct.Element("CH", "AAGCTT"), construct.Element("stop", "TGA", "stop"))),
        construct.Cassette("light", (construct.Element("signal", "ATGAAA"), construct.Element("intron", "GGG", translated=False), construct.Element("stop", "TAA", "stop"), construct.Element("polyA"))),
    ),
)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(construct, "VECTORS", type(construct.VECTORS)("vector"))
    assert construct.register_vector(VECTOR, enzyme="BsaI") is construct.VECTORS.get("two")
    with pytest.raises(ValueError):
        construct.register_vector(VECTOR)
    frame = spark.createDataFrame([("GGTACC",)], "dna string")
    insert = F.col("dna")
    assert {n: frame.select(c).first()[0] for n, c in VECTOR.orfs(insert).items()} == {"heavy": "ATGGGATCCGGTACCAAGCTTTGA", "light": "ATGAAATAA"}
    assert {n: frame.select(c).first()[0] for n, c in VECTOR.proteins(insert).items()} == {"heavy": "MGSGTKL*", "light": "MK*"}
    assert VECTOR.declared_bp(6) == {"heavy/signal": 9, "heavy/VH": 6, "heavy/CH": 6, "heavy/stop": 3, "light/signal": 6, "light/intron": 3, "light/stop": 3, "total": 36, "undeclared": 2}
    assert VECTOR.fusion_sites() == ("ATCC", "AAGC")
    with pytest.raises(ValueError):
        construct.vector_of("none", VECTOR.cassettes[1:])


def test_constructs(spark):
    rows = spark.createDataFrame([("s1", "EVQ"), ("s2", "QVQ")], "seq_id string, aa_seq string")
    made = construct.build(rows, "DIQ").collect()
    assert {r["clone_aa_seq"] for r in made} == {"EVQGGGGSGGGGSGGGGSDIQ", "QVQGGGGSGGGGSGGGGSDIQ"} and len({r["clone_id"] for r in made}) == 2
    assert {r["clone_aa_seq"] for r in construct.build(rows, fmt="vh_only").collect()} == {"EVQ", "QVQ"}
    with pytest.raises(ValueError):
        construct.build(rows)
    table = spark.createDataFrame([("IGKV1-39", "DIQ")], "gene string, sequence string")
    assert construct.light_chain_for("IGKV1-39", [("table", table)], spark)["source"] == "table"
    assert construct.light_chain_for("", [("table", table)], spark) is None


# ---------------------------------------------------------------- runs


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        gene = ("IGHV3-23", "IGHV1-69", "IGHV3-53")[i % 3]
        loop = "".join(rng.choices(LETTERS, k=rng.randrange(8, 24)))
        rows.append((f"SEQ-{i:03d}", gene, gene[:5], "H", loop, len(loop), "EVQLVESGGG" + "".join(rng.choices(LETTERS, k=20)) + loop + "WGQG", "EVQLVESGGGWGQG", "T", 1, False, 0))
    return spark.createDataFrame(rows, "seq_id string, v_gene string, v_family string, chain string, cdr3_aa string, cdr3_len int, aa_seq string, germline_aa string, productive string, redundancy int, has_liability boolean, n_ambiguous int")


def test_selection_and_order(spark, pool, tmp_path):
    panel = selection.PANELS["default-v1"]
    picked, bundle = runs.select_sequences(pool, 24, panel, tmp_path / "sel", {"study": "A"})
    rows = picked.collect()
    assert len(rows) == 24 and {g: sum(r["v_gene"] == g for r in rows) for g in panel.fractions} == panel.quotas(24)
    manifest = bundle.manifest
    assert manifest["sections"]["pool"]["n"] == 300 and manifest["sections"]["filter"]["funnel"][0]["rows"] == 300
    assert set(manifest["sections"]["alignments"]) == set(panel.fractions)
    files = {f["path"] for f in manifest["files"]}
    assert {"selected.csv", "filter_funnel.csv", "pool_summary.csv", "summary.md", "alignment_IGHV3-23.fasta"} <= files and all((tmp_path / "sel" / f).exists() for f in files)
    assert "24 of 24 asked for" in (tmp_path / "sel" / "summary.md").read_text()

    members = pool.join(picked.select("seq_id", "rank"), "seq_id")
    clones = runs.design_order(members, VECTOR, barcode="BC1", reserved=("A01",), sources=[("none", spark.createDataFrame([], "gene string, sequence string"))], light_chain="IGKV1-39")
    made = clones.collect()
    assert len(made) == 24 and len({r["well"] for r in made}) == 24 and "A01" not in {r["well"] for r in made}
    for r in made:
        assert "".join(CODONS[r["insert_dna_seq"][i : i + 3]] for i in range(0, len(r["insert_dna_seq"]), 3)) == r["aa_seq"]
        assert r["aa_seq"] in r["clone_aa_seq"] and r["insert_dna_seq"] in r["order_dna_seq"] and r["assembly_problems"] is None and r["n_chains"] == 2
    assert runs.design_order(members, VECTOR, barcode="BC1", by_similarity=False).where("rank = 0").first()["well"] == "A01"
    text = runs.order_markdown(clones, VECTOR, "LIB-1")
    assert "24 fragments" in text and "2 cassettes: heavy, light" in text
    shown = runs.plate_text(clones, "cdr3_aa").split("\n")
    assert len(shown[1:9]) == 8 and shown[1].split()[1] == "-" and shown[-2].startswith("24 clones")

    library, book = (stores.connect(spark, n, str(tmp_path / "stores")) for n in ("library", "ledger"))
    assert stores.register_clones(library, book, clones, "LIB-clones", "test", "2020") == "LIB-clones"
    assert library.table("clones").count() == 24 and book.table("artifacts").first()["obj_type"] == "clone_set"
    order = [r["seq_id"] for r in library.table("library_members").orderBy("rank").collect()]
    assert order == [r["seq_id"] for r in sorted(made, key=lambda r: (r["well"][1:], r["well"]))]


def test_hit_calling_run(spark, tmp_path):
    made = simulate.simulate_pairs(spark, 20).cache()
    samples = made.where("role = 'sample'").select("pair_id", "well", "od450_target", "od450_control", "is_binder")
    tables, bundle = runs.call_hits(samples, samples, tmp_path)
    assert tables["callers"].count() == 4 and bundle.manifest["sections"]["data"] == {"simulated": True, "pairs": 20}
    assert sum(r["plates"] for r in tables["by_verdict"].collect()) == 20
    live = hits.plate_context(samples, samples).where("binders > 0").count()
    assert sum(r["plates"] for r in tables["by_dynamic_range"].collect()) == sum(r["plates"] for r in tables["by_saturation"].collect()) == live
    told = hits.reasons(hits.plate_health(samples)).collect()
    assert all((r["verdict"] == "callable") == (not any("background" in x for x in r["reasons"])) for r in told)


def test_classifier_reports(spark):
    rows = [("p1", 1.0, 1.0, "usual", 5), ("p2", 0.0, 1.0, "usual", 0), ("p3", 1.0, 0.0, "weak", 40), ("p4", 1.0, 1.0, "weak", 1)]
    got = {(r["measure"], r["name"]): (r["accuracy"], r["plates"]) for r in classify.baseline(spark.createDataFrame(rows, "plate_id string, label double, prediction double, scenario string, n_binders int")).collect()}
    assert got == {("all", "all"): (0.5, 4), ("scenario", "usual"): (0.5, 2), ("scenario", "weak"): (0.5, 2), ("binders", "0"): (0.0, 1), ("binders", "1"): (1.0, 1), ("binders", "2"): (1.0, 1), ("binders", "4"): (0.0, 1)}
    models = spark.createDataFrame([("m1", "a", "2020"), ("m2", "b", "2021")], "model_id string, path string, created_at string")
    assert classify.latest_model(models)["path"] == "b" and classify.latest_model(models.limit(0)) is None


def test_small_helpers(tmp_path):
    for n in ("a.png", "b.png", "c.csv"):
        (tmp_path / n).write_text("")
    assert [p.name for p in runs.stale(tmp_path, ["a.png"])] == ["b.png"] and runs.stale(tmp_path / "none", []) == []


# ---------------------------------------------------------------- files


def test_workbooks(spark, tmp_path):
    one, two = ({f"{r}{c:02d}": round(ord(r) + c / 100, 2) for r in "ABCDEFGH" for c in range(1, 13)} for _ in range(2))
    del two["C05"]
    workbooks.write_workbook(tmp_path / "run.xlsx", [("Plate <1>", one), ("a/b", two)])
    got = grids.read(spark, str(tmp_path / "run.xlsx"), "biotek_gen5", allow_unverified=True).collect()
    for place, values in enumerate((one, two)):
        assert {r["well"]: r["od450"] for r in got if r["grid"] == place} == values
    assert any("Plate Number Plate <1>" in r["text"] for r in got) and any("a_b" in r["text"] for r in got)
    with pytest.raises(ValueError):
        grids.read(spark, str(tmp_path / "run.xlsx"), "biotek_gen5")


def test_studies(spark, tmp_path):
    for study, n in (("A et al., 2019", 2), ("B", 1)):
        spark.range(10).repartition(n).write.parquet(f"{tmp_path}/heavy/{study}")
    assert {r["study"]: r["shards"] for r in repertoire.list_studies(spark, str(tmp_path)).collect()} == {"A et al., 2019": 2, "B": 1}
    assert len(repertoire.study_files(spark, str(tmp_path), "a ET AL 2019")) == 2


def test_sequencing_run(spark):
    rng = random.Random(2)
    inserts = {f"CL{k}": "".join(rng.choices("ACGT", k=240)) for k in range(3)}
    clones = spark.createDataFrame([(n, f"{'ABC'[k]}1", s, k) for k, (n, s) in enumerate(inserts.items())], "clone_id string, well string, insert_dna_seq string, ordinal int")
    reads = [("f0", "CL0", "A01", inserts["CL0"], 2), ("f1", "CL1", "B01", inserts["CL2"], 1), ("f2", "CL2", "C01", inserts["CL2"][:40], 1), ("f3", "CL0_rerun", "A01", inserts["CL0"][:120] + inserts["CL0"][121:], 1)]
    traces = spark.createDataFrame([(f, s, w, q, [40] * len(q), t, len(q)) for f, s, w, q, t in reads], "file string, sample string, well string, sequence string, quality array<int>, run_started int, q20 int")
    calls = sequencing.verify(traces, sequencing.expectations_from(clones))
    assert {r["file"]: r["verdict"] for r in calls.collect()} == {"f0": "exact", "f1": "wrong_clone", "f2": "low_quality"}
    assert [r["well"] for r in sequencing.usable_wells(calls).collect()] == ["A01"]
    said = {r["file"]: r for r in calls.collect()}
    assert (said["f1"]["matched"], said["f1"]["identity"], said["f1"]["mean_quality"], said["f1"]["sample"], said["f1"]["run_started"]) == ("CL2", 1.0, 40.0, "CL1", 1)
    assert "229" in said["f1"]["notes"] and "40 bp" in said["f2"]["notes"]


def test_modes_have_no_vote_of_blanks(spark):
    frame = spark.createDataFrame([("a", ""), ("a", None), ("a", "x"), ("b", "y"), ("b", "z")], "k string, v string")
    assert {(r["k"], r["v"], r["votes"]) for r in alignment.modal(frame, ["k"], "v").collect()} == {("a", "x", 1), ("b", "y", 1)}


def test_link_counts_once(spark):
    """Old links stay as often as they are, new ones come once, without a join of both sides."""
    schema = "parent_id long, child_id long, relationship string"
    old = spark.createDataFrame([(1, 2, "made"), (1, 2, "made"), (3, None, "used")], schema)
    new = spark.createDataFrame([(1, 2, "made"), (1, 2, "used"), (1, 2, "used"), (3, None, "used")], schema)
    out = ledger.link(old, new)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, "made"), (1, 2, "made"), (1, 2, "used"), (3, None, "used")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_of_many_starts_is_that_of_their_parents(spark, monkeypatch):
    """Halving graphs with a cycle at the root and ways of unequal length, against a search of each start."""
    n = 300
    links = sorted({(k // 2, k) for k in range(1, n)} | {(k // 3, k) for k in range(1, n)} | {(7, 0), (1, 0)})
    up = {k: {p for p, c in links if c == k} for k in range(n)}
    wanted = set()
    for start in range(n):
        seen, ends, depth = {start}, {start}, 0
        while ends:
            depth += 1
            ends = {p for e in ends for p in up[e]} - seen
            seen |= ends
            wanted |= {(start, e, depth) for e in ends}
    frame = spark.createDataFrame([(p, c, "made") for p, c in links], "parent_id long, child_id long, relationship string")
    monkeypatch.setattr(ledger, "MANY_STARTS", 20)
    searched = []
    search = ledger._breadth_first
    monkeypatch.setattr(ledger, "_breadth_first", lambda edges, starts, levels=None: searched.append(starts.count()) or search(edges, starts, levels))
    got = ledger.lineage(frame, spark.range(n).withColumnRenamed("id", "obj_id")).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    assert searched == [searched[0]] and searched[0] < 40


def test_translation_is_made_once(spark):
    """However often the problems of an assembly name it; characters beyond ASCII are one each, a rest is no codon."""
    from sparkwell.functions import dna

    rows = spark.createDataFrame([("ATGTAAG",), ("atgGCéNNNTGG𝄞C",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(dna.translate(F.col("s"))).collect()] == ["M*", "XXXW", "", None]
    vector = construct.Vector("v", upstream="GCTAGC", downstream="TCTAGA", coding_before="ATGGGATCC", coding_after="AAGCTT")
    plan = rows.select(construct.assembly_problems(F.col("s"), F.col("s"), vector, F.lit("MGS")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_translated(") == 1 and plan.count("pythonUDF0#") and "pythonUDF1#" not in plan


def test_germline_columns_make_sequences_once(spark):
    """A filter on the columns must not make the sequences again for each place that names them."""
    rows = spark.createDataFrame([("a", "x1ACx", "AC", "GT"), ("b", "A-C", "A-C", "GTW"), ("c", "AC", "AC", "G")], "seq_id string, raw string, gapped string, germline string")
    numbering = F.concat(F.lit("{'fwh1': {'1 ': 'A', '2 ': 'C'"), F.regexp_replace("raw", ".", ""), F.lit("}}"))
    frame = rows.select("seq_id", numbering.alias("anarci_numbering"), F.col("gapped").alias("aa_gapped"), F.col("germline").alias("germline_aa"))
    out = reference.germline_by_column(frame)
    assert sorted(map(tuple, out.collect())) == [("a", "1", "G"), ("a", "2", "T"), ("b", "1", "G"), ("b", "2", "W")]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
