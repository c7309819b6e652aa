"""Screening, constructs, traces, alignments."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import alignment, construct, sequencing
from ..operators.storage import checkpointed
from . import derive as d
from .catalog import query


@query("""
    WITH i AS (SELECT DISTINCT item_id, kmer FROM (SELECT item_id, upper(substr(text, CAST(p AS BIGINT), 12)) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 10)) AS p FROM benchmark WHERE length(text) >= 12)) WHERE NOT contains(kmer, 'N')),
    q AS (SELECT DISTINCT doc_id, kmer FROM (SELECT doc_id, upper(substr(text, CAST(p AS BIGINT), 12)) AS kmer FROM (SELECT doc_id, text, unnest(range(1, length(text) - 10)) AS p FROM documents WHERE length(text) >= 12)) WHERE kmer IN (SELECT kmer FROM i)),
    s AS (SELECT doc_id, item_id, count(*) AS shared FROM q JOIN i USING (kmer) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS place FROM s)
    SELECT doc_id AS read_id, item_id AS ref_id, shared, place FROM r WHERE place <= 3
""")
def kmer_screen(spark, sf):
    """Documents against benchmark items by shared 12-mers, one strand: letters have no complement."""
    from ..operators.screen import screen_one_strand

    return screen_one_strand(d.table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")), d.table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("seq")))


_CDS = d.DNA_SQL


def _inserts(spark, sf):
    """The whole of every document as an insert."""
    return d.texts(spark, sf).select("doc_id", d.bases().alias("insert_dna_seq")).where(F.length("insert_dna_seq") >= 60)


VECTOR = construct.Vector("test", upstream="GCTAGCACCATGGGATCC", downstream="TCTAGAAGCTTGCGGCCGC", coding_before="ATGGGATCC", coding_after="AAGCTT")
_FILL = construct.FILLER * (1 + (300 + 31 + 16) // len(construct.FILLER))


@query(f"""
    WITH i AS (SELECT doc_id, {_CDS} AS cds FROM documents WHERE length({_CDS}) >= 60), c AS (SELECT *, concat('GGTCTCA', 'ATCC', cds, 'TCTA', 'A', 'GAGACC') AS core FROM i),
    p AS (SELECT *, greatest(0, 300 - length(core) - 16) AS short FROM c),
    f AS (SELECT doc_id, cds, concat(substr('{_FILL}', 1, CAST(8 + ceil(short / 2) AS BIGINT)), core, substr('{_FILL}', 32, CAST(8 + floor(short / 2) AS BIGINT))) AS fragment FROM p)
    SELECT doc_id, md5(fragment) AS digest, CAST(length(fragment) AS BIGINT) AS order_length, round(length(regexp_replace(fragment, '[^GC]', '', 'g')) / length(fragment), 6) AS order_gc,
           NOT (contains(cds, 'GGTCTC') OR contains(cds, 'GAGACC')) AS cloneable FROM f
""")
def golden_gate_fragments(spark, sf):
    out = construct.design(_inserts(spark, sf), VECTOR, "golden_gate")
    return out.select("doc_id", F.md5("order_dna_seq").alias("digest"), F.col("order_length").cast("long").alias("order_length"), "order_gc", "cloneable")


@query(f"SELECT doc_id, md5(concat('{VECTOR.upstream}', cds, '{VECTOR.downstream}')) AS digest FROM (SELECT doc_id, {_CDS} AS cds FROM documents) WHERE length(cds) >= 60")
def gibson_fragments(spark, sf):
    return construct.design(_inserts(spark, sf), VECTOR, "gibson", arm=25).select("doc_id", F.md5("order_dna_seq").alias("digest"))


_TABLE = ", ".join(f"'{c}': '{r}'" for c, r in dna.CODONS.items())


@query(f"""
    WITH i AS (SELECT doc_id, {_CDS} AS cds FROM documents), o AS (SELECT doc_id, cds, concat('ATGGGATCC', cds, 'AAGCTT', 'TAA') AS orf, MAP {{{_TABLE}}} AS m FROM i WHERE length(cds) >= 60),
    t AS (SELECT *, array_to_string(list_transform(range(0, CAST(length(orf) // 3 AS BIGINT)), lambda i: coalesce(element_at(m, substr(orf, CAST(3 * i + 1 AS BIGINT), 3))[1], 'X')), '') AS p FROM o)
    SELECT doc_id, list_filter([CASE WHEN length(orf) % 3 <> 0 THEN 'out of frame' END, CASE WHEN contains(substr(p, 1, length(p) - 1), '*') THEN 'stop inside the frame' END, CASE WHEN NOT contains(p, 'MGS') THEN 'the protein is not in the frame' END], lambda x: x IS NOT NULL) AS problems FROM t
""")
def assembly_verify(spark, sf):
    cds = F.col("insert_dna_seq")
    return _inserts(spark, sf).select("doc_id", construct.assembly_problems(cds, cds, VECTOR, F.lit("MGS")).alias("problems"))


@query(f"""
    WITH s AS (SELECT doc_id, dna, round(length(regexp_replace(dna, '[^GC]', '', 'g')) / greatest(1, length(dna)), 6) AS gc FROM (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents) WHERE length(dna) > 0)
    SELECT doc_id AS name, unnest(list_filter([CASE WHEN length(dna) < 300 THEN concat(length(dna), ' bp is below 300') END, CASE WHEN length(dna) > 1500 THEN concat(length(dna), ' bp is above 1500') END, CASE WHEN gc < 0.25 THEN 'GC is below 25%' END, CASE WHEN gc > 0.65 THEN 'GC is above 65%' END,
           CASE WHEN regexp_matches(dna, 'A{{9,}}|C{{9,}}|G{{9,}}|T{{9,}}') THEN 'a run of more than 8 equal bases' END], lambda x: x IS NOT NULL)) AS issue FROM s
""")
def vendor_issues(spark, sf):
    rows = d.texts(spark, sf).select("doc_id", d.bases().alias("s")).where(F.length("s") > 0)
    return construct.vendor_issues(rows, construct.Limits(), "doc_id", "s")


@query(f"""
    WITH i AS (SELECT doc_id, {_CDS} AS cds FROM documents WHERE length({_CDS}) >= 60), f AS (SELECT length(cds) + 50 AS n, cds FROM i)
    SELECT count(*) AS n, CAST(min(length(cds)) AS BIGINT) AS min_length, CAST(max(length(cds)) AS BIGINT) AS max_length, CAST(sum(length(cds)) AS BIGINT) AS total_length,
           round(min(round(length(regexp_replace(cds, '[^GC]', '', 'g')) / length(cds), 6)), 3) AS min_gc, round(max(round(length(regexp_replace(cds, '[^GC]', '', 'g')) / length(cds), 6)), 3) AS max_gc, count(*) AS with_warnings, count(*) AS not_cloneable FROM f
""")
def clone_report(spark, sf):
    return construct.clone_report(construct.design(_inserts(spark, sf), VECTOR, "blunt"))


@query()
def codon_optimize(spark, sf):
    """DNA for all residues of each document."""
    rows = d.texts(spark, sf).select("doc_id", d.protein().alias("insert_aa_seq"))
    return construct.optimize_codons(rows)


_QUALITY = "list_transform(string_split(text, ''), lambda c: CAST(ascii(c) % 45 AS DOUBLE))"


@query(f"""
    WITH t AS (SELECT doc_id, list_transform({_QUALITY}, lambda v: 0.01 - power(10.0, -v / 10.0)) AS w FROM documents WHERE text <> ''),
    s AS (SELECT doc_id, list_reduce(list_transform(w, lambda v, i: [v, i, 0, 0, 0, 0]), lambda x, y: [
              CASE WHEN x[1] + y[1] < 0 THEN 0 ELSE x[1] + y[1] END, y[2], CASE WHEN x[1] + y[1] < 0 THEN y[2] ELSE x[3] END,
              greatest(x[4], x[1] + y[1]), CASE WHEN x[1] + y[1] > x[4] THEN x[3] ELSE x[5] END, CASE WHEN x[1] + y[1] > x[4] THEN y[2] ELSE x[6] END], [0.0::DOUBLE, 0, 0, 0, 0, 0]) AS e FROM t)
    SELECT doc_id, CAST(CASE WHEN e[6] - e[5] >= 20 THEN e[5] ELSE 0 END AS INTEGER) AS start, CAST(CASE WHEN e[6] - e[5] >= 20 THEN e[6] ELSE 0 END AS INTEGER) AS "end" FROM s
    UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE text = ''
""")
def mott_trim(spark, sf):
    """The best stretch of each whole document; its letters stand for qualities."""
    rows = d.texts(spark, sf).where("text IS NOT NULL").select("doc_id", F.when(F.col("text") == "", F.array().cast("array<int>")).otherwise(F.transform(F.split("text", ""), lambda c: (F.ascii(c) % 45).cast("int"))).alias("q"))
    return rows.select("doc_id", sequencing.mott_trim(F.col("q")).alias("t")).select("doc_id", "t.start", "t.end")


#: Marks of reruns in the samples' names.
RERUN_MARKS = ("_RR", "_rerun", "-re-run", " Rerun", ".repeat", "_-redo", *(f"_run{i}" for i in range(2, 10)), *(f"-v{i}" for i in range(2, 10)), *(f".r{i}" for i in range(2, 10)), " (1)", "(12)")


@query("""
    WITH t AS (SELECT conv_id, turn, length(text) AS q20, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN NULL WHEN conv_id % 7 = 0 THEN turn // 2 ELSE turn END AS run FROM conversations),
    w AS (SELECT *, count(*) OVER s AS n, count(*) FILTER (run IS NULL) OVER s AS unknown, max(run) OVER s AS best, max(q20) OVER s AS top FROM t WINDOW s AS (PARTITION BY conv_id)),
    x AS (SELECT *, count(*) FILTER (run = best) OVER (PARTITION BY conv_id) AS ties, max(q20) FILTER (run = best) OVER (PARTITION BY conv_id) AS mine FROM w),
    y AS (SELECT *, CASE WHEN n = 1 THEN 'only' WHEN unknown > 0 OR ties > 1 THEN 'unresolved' WHEN run = best THEN 'kept' ELSE 'superseded' END AS status FROM x)
    SELECT conv_id, turn, concat('S', conv_id) AS stem, status, CASE WHEN status = 'kept' AND top > mine THEN 'a superseded run has more good bases' ELSE '' END AS warning FROM y
""")
def resolve_reruns(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, RERUN_MARKS)), ((F.col("conv_id") + F.col("turn")) % len(RERUN_MARKS) + 1).cast("int"))
    rows = d.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("S"), F.col("conv_id").cast("string"), F.when(F.col("turn") > 0, F.repeat(mark, (1 + F.col("turn") % 2).cast("int"))).otherwise("")).alias("sample"), F.length("text").alias("q20"),
        F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1), None).when(F.col("conv_id") % 7 == 0, F.floor(F.col("turn") / 2)).otherwise(F.col("turn")).alias("run_started"),
    )
    return sequencing.resolve_reruns(rows).select("conv_id", "turn", "stem", "status", "warning")


#: Eight clones of 240 bases.
CLONES = tuple((f"CL{k}", f"{'ABCDEFGH'[k]}01", "".join("ACGT"[int(c, 16) % 4] + "ACGT"[int(c, 16) // 4] for c in hashlib.sha512(f"clone {k}".encode()).hexdigest())[:240]) for k in range(8))


def _reads(spark, sf):
    """Every document is a read of one of the clones, changed by a rule."""
    clones = spark.createDataFrame([(*c, "") for c in CLONES], "clone_id string, well string, insert string, context string")
    docs = d.texts(spark, sf).select("doc_id", F.concat(F.substring(F.lit("ABCDEFGH"), (F.col("doc_id") % 8 + 1).cast("int"), F.lit(1)), F.lit("01")).alias("well")).join(F.broadcast(clones), "well")
    seq, kind = F.col("insert"), F.col("doc_id") % 6
    read = F.when(kind == 0, seq).when(kind == 1, F.concat(F.substring(seq, 1, 100), F.lit("T"), F.substring(seq, 102, 200))).when(kind == 2, F.concat(F.substring(seq, 1, 100), F.substring(seq, 102, 200))).when(kind == 3, F.substring(seq, 1, 50)).when(kind == 4, dna.reverse_complement(seq)).otherwise(F.concat(F.substring(seq, 1, 99), F.substring(seq, 103, 200)))
    traces = docs.select(F.col("doc_id").cast("string").alias("file"), "well", "clone_id", read.alias("sequence"), F.lit(0).alias("start"), F.length(read).alias("end"), "insert", "context")
    return traces, [(n, s) for n, _, s in CLONES]


_CODON_ROWS = ", ".join(f"('{c}', '{r}')" for c, r in dna.CODONS.items())


@query(f"""
    WITH c(k, clone_id, s) AS (VALUES {", ".join(f"({k}, '{n}', '{s}')" for k, (n, _, s) in enumerate(CLONES))}), t(codon, residue) AS (VALUES {_CODON_ROWS}),
    r AS (SELECT doc_id, clone_id, s, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN s WHEN 1 THEN concat(substr(s, 1, 100), 'T', substr(s, 102)) WHEN 2 THEN concat(substr(s, 1, 100), substr(s, 102)) WHEN 3 THEN substr(s, 1, 50) WHEN 4 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE concat(substr(s, 1, 99), substr(s, 103)) END AS q FROM documents JOIN c ON c.k = doc_id % 8),
    p AS (SELECT s, q, string_agg(a.residue, '' ORDER BY i) AS old, string_agg(b.residue, '' ORDER BY i) AS now FROM (SELECT DISTINCT s, q, unnest(range(0, 80)) AS i FROM r WHERE length(q) = 240) JOIN t a ON a.codon = substr(s, CAST(3 * i + 1 AS BIGINT), 3) JOIN t b ON b.codon = substr(q, CAST(3 * i + 1 AS BIGINT), 3) GROUP BY 1, 2)
    SELECT CAST(doc_id AS VARCHAR) AS file, clone_id, CASE WHEN length(q) < 60 THEN 'low_quality' WHEN q = s OR q = reverse(translate(s, 'ACGT', 'TGCA')) THEN 'exact' WHEN length(q) = length(s) THEN CASE WHEN old = now THEN 'silent' ELSE 'missense' END WHEN (length(s) - length(q)) % 3 <> 0 THEN 'frameshift' ELSE 'indel' END AS verdict,
           CASE WHEN length(q) >= 60 THEN round(CASE WHEN length(q) < 240 THEN length(q) / 240 WHEN q = reverse(translate(s, 'ACGT', 'TGCA')) OR q = s THEN CAST(1 AS DOUBLE) ELSE 239 / 240 END, 4) END AS identity, CASE WHEN length(q) >= 60 THEN CAST(1 AS DOUBLE) END AS coverage,
           length(q) AS trimmed_bp, CASE WHEN length(q) >= 60 THEN clone_id END AS matched, CASE WHEN length(q) >= 60 THEN CASE WHEN q = s OR q = reverse(translate(s, 'ACGT', 'TGCA')) THEN 0 ELSE 1 END END AS n_differences,
           length(q) >= 60 AND q = reverse(translate(s, 'ACGT', 'TGCA')) AS reversed
    FROM r LEFT JOIN p USING (s, q)
""")
def sanger_calls(spark, sf):
    """The verdict on every read; SQL tells it from read and insert, as each read has one change at most."""
    traces, panel = _reads(spark, sf)
    calls = sequencing.call_traces(traces, panel)
    return calls.select("file", "clone_id", "verdict", F.round("identity", 4).alias("identity"), "coverage", "trimmed_bp", "matched", "n_differences", F.col("notes").contains("reverse strand").alias("reversed"))


def _first_of_genes(pool):
    """The first sequence of each gene in place of its germline."""
    return pool.where("trim(aa_seq) <> ''").groupBy("v_gene").agg(F.min_by("aa_seq", "seq_id").alias("germline_aa"))


@query()
def align_to_germline(spark, sf):
    """The rows that an alignment of each gene shows against the first of the gene, in shared columns."""
    pool = d.pool(spark, sf)
    return alignment.align_to_germline(alignment.rows_to_align(pool), _first_of_genes(pool))


@query()
def germline_differences(spark, sf):
    """Every row of the pool against the first of its gene."""
    pool = d.pool(spark, sf).where("aa_seq IS NOT NULL")
    return alignment.germline_changes(alignment.with_germline(pool, checkpointed(_first_of_genes(pool))))


def _numbered(spark, sf):
    """Letters of each sequence at IMGT positions; one row in three has no insertion 112B."""
    p = d.pool(spark, sf).where("length(aa_seq) >= 6")
    letter = lambda i: F.substring("aa_seq", i, 1)
    inserted = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("', '112B': '"), letter(4)))
    text = F.concat(F.lit("{'fwh1': {'1 ': '"), letter(1), F.lit("', '2 ': '-'}, 'cdrh3': {'111 ': '"), letter(3), inserted, F.lit("', '112A': '"), letter(5), F.lit("', '112 ': '"), letter(6), F.lit("'}}"))
    return p.select("seq_id", text.alias("anarci_numbering"))


_LETTERS = f"""
    WITH p AS (SELECT doc_id, aa_seq FROM ({d.REPERTOIRE_SQL}) WHERE length(aa_seq) >= 6),
    l AS (SELECT doc_id, x.position, substr(aa_seq, x.place, 1) AS residue FROM p, (SELECT unnest([{{'position': '1', 'place': 1}}, {{'position': '111', 'place': 3}}, {{'position': '112B', 'place': 4}}, {{'position': '112A', 'place': 5}}, {{'position': '112', 'place': 6}}]) AS x) WHERE x.position <> '112B' OR doc_id % 3 <> 0)
"""


@query(f"""
    {_LETTERS}, v AS (SELECT position, residue, count(*) AS votes FROM l GROUP BY 1, 2)
    SELECT position, residue, votes FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY votes DESC, residue) AS r FROM v) WHERE r = 1
""")
def imgt_consensus(spark, sf):
    return alignment.column_consensus(alignment.numbered_long(_numbered(spark, sf)))


@query(f"""
    {_LETTERS}, o AS (SELECT position, count(DISTINCT doc_id) / (SELECT count(*) FROM p) AS occupancy, CAST(regexp_extract(position, '^[0-9]+') AS INT) AS n, coalesce(ascii(nullif(regexp_extract(position, '[A-Z]$'), '')), 64) - 64 AS k FROM l GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY n, CASE WHEN n = 112 THEN -k ELSE k END) AS INTEGER) AS place, position, CASE WHEN n <= 26 THEN 'fwh1' ELSE 'cdrh3' END AS region, occupancy FROM o
""")
def msa_columns(spark, sf):
    """Positions in IMGT order: insertions at 112 run backwards, before the bare position."""
    rows = _numbered(spark, sf)
    return alignment.columns_of(alignment.numbered_long(rows), rows.count())


#: Residues in a circle; a planted change takes the residue seven further on.
_CIRCLE = "ACDEFGHIKLMNPQRSTVWY"
_TURNED = _CIRCLE[7:] + _CIRCLE[:7]


def _planted(every: int, *places: int):
    """The residues of each document, turned at each of ``places`` of every so many."""
    pieces = F.regexp_extract_all("aa", F.lit(f".{{1,{every}}}"), F.lit(0))
    cuts = [0, *places, every]

    def turned(piece):
        kept = [F.substring(piece, a + 1, b - a - 1 if b in places else b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        changed = [F.translate(F.substring(piece, p, 1), _CIRCLE, _TURNED) for p in places]
        return F.concat(*[x for pair in zip(kept, [*changed, F.lit("")], strict=True) for x in pair])

    return F.array_join(F.transform(pieces, turned), "")


def _proteins(spark, sf):
    return d.texts(spark, sf).select("doc_id", d.protein().alias("aa")).where("aa <> ''")


_PROTEIN_SQL = "SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS aa FROM documents"


@query(f"""
    WITH p AS (SELECT doc_id, aa, unnest(range(150, length(aa) + 1, 1009)) AS i FROM ({_PROTEIN_SQL}))
    SELECT CAST(doc_id AS VARCHAR) AS seq_id, CAST(i AS INTEGER) AS number, substr(aa, i, 1) AS germline, translate(substr(aa, i, 1), '{_CIRCLE}', '{_TURNED}') AS observed FROM p
""")
def germline_substitutions(spark, sf):
    """Every whole document is a germline, and its read has one residue in 1009 changed; alignment must find all of these and nothing else."""
    rows = _proteins(spark, sf).select(F.col("doc_id").cast("string").alias("seq_id"), F.col("aa").alias("germline_aa"), _planted(1009, 150).alias("aa_seq"))
    return alignment.germline_changes(rows)


@query(f"""
    WITH p AS (SELECT doc_id, aa, length(aa) AS n FROM ({_PROTEIN_SQL}) WHERE aa <> ''),
    s AS (SELECT doc_id, n, list_transform(string_split(aa, ''), lambda c, i: CASE WHEN i % 1009 <> 150 OR n < 400 THEN c WHEN n < 700 THEN least(c, translate(c, '{_CIRCLE}', '{_TURNED}')) ELSE translate(c, '{_CIRCLE}', '{_TURNED}') END) AS x FROM p)
    SELECT CAST(doc_id AS VARCHAR) AS v_gene, md5(array_to_string(x, '')) AS digest,
           CAST(1 + (n > 20)::INT + (n >= 150)::INT + (n >= 400)::INT + (n >= 700)::INT AS BIGINT) AS votes FROM s
""")
def consensus_germline(spark, sf):
    """Five germlines of each whole document: its own, three alleles that share some changes, and a read that lacks the first residues; a change wins that three of them share, and a tie goes to the least residue."""
    docs = _proteins(spark, sf)
    one = lambda *places: _planted(1009, *places) if places else F.col("aa")
    alleles = F.array(one(), one(150), one(150, 400), one(150, 700), F.expr("substr(aa, 21)"))
    seen = docs.select(F.col("doc_id").cast("string").alias("v_gene"), F.explode(alleles).alias("germline_aa"))
    return alignment.consensus_germline(seen).select("v_gene", F.md5("germline_aa").alias("digest"), "votes")


@query(f"""
    WITH c AS (SELECT doc_id, {d.DNA_SQL} AS dna FROM documents), s AS (SELECT *, round(length(regexp_replace(dna, '[^GC]', '', 'g')) / greatest(1, length(dna)), 6) AS gc FROM c WHERE length(dna) > 0),
    i AS (SELECT *, (length(dna) < 300)::INT + (length(dna) > 1500)::INT + (gc < 0.25)::INT + (gc > 0.65)::INT + regexp_matches(dna, 'A{{9,}}|C{{9,}}|G{{9,}}|T{{9,}}')::INT AS k FROM s)
    SELECT count(*) AS fragments, CAST(sum(length(dna)) AS BIGINT) AS bases, CAST(sum(k) AS BIGINT) AS issues, count(*) FILTER (k > 0) AS failing FROM i
""")
def vendor_summary(spark, sf):
    from ..sinks import orders

    rows = d.texts(spark, sf).select("doc_id", d.bases().alias("s")).where(F.length("s") > 0)
    return orders.summary(rows, "idt_eblocks", "doc_id", "s")
