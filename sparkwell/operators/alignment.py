"""Alignments by gene, identity to germline, numbered matrices, consensus."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import imgt
from ..kernels import anchored, gotoh
from .spread import MAX_BYTES, MAX_ROWS, broadcast_within, sliced
from .storage import checkpointed

_STANDARD = frozenset("ACDEFGHIKLMNPQRSTVWY")
#: Pairs that are aligned together, as their slots are held.
MOST_PAIRS = 4096
#: Changes that are handed on together, and letters of germlines and their anchors that are aligned together.
MOST_CHANGES, TOGETHER = 1 << 17, 1 << 23
_ALIGNED = "v_gene string, seq_id string, gapped string, identity double, n_columns int"


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key and its votes; the least of equals. Nulls and blanks have no vote."""
    votes = rows.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), value)).alias("b"))
    return best.select(*keys, f"b.{value}", "b.votes")


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v_gene, bundle, size) of (v_gene, germline) rows: the distinct germlines of a gene among neighbouring rows, packed together, as alleles are much alike."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        for part in sliced(batch, rows=4096, size=1 << 22):
            of: dict[str, dict[str, None]] = {}
            for gene, letters in zip(*(c.to_pylist() for c in part.columns), strict=True):
                of.setdefault(gene, {})[letters] = None
            plain = [json.dumps(list(x)).encode() for x in of.values()]
            packed = [codec.compress(x, asbytes=True) for x in plain]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(packed, pa.binary()), pa.array(map(len, plain), pa.int64())], names=["v_gene", "bundle", "size"])


def _points(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)


def _as_letters(points: np.ndarray) -> pa.Array:
    """A string of each code point."""
    if len(points) and points.max() > 127:
        return pa.array(map(chr, points.tolist()), pa.string())
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.arange(len(points) + 1, dtype=np.int32)), pa.py_buffer(points.astype(np.uint8)))


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v_gene, anchor) of (v_gene, bundle, size) rows: the longest germline of each, of equally long ones the least."""
    for batch in batches:
        for part in sliced(batch, rows=4096, size=1 << 20):
            best = [min(_unpacked(b, n), key=lambda x: (-len(x), x)) for b, n in zip(part.column(1), part.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string())], names=["v_gene", "anchor"])


def _unpacked(bundle: pa.Scalar, size: pa.Scalar) -> list[str]:
    return json.loads(pa.decompress(bundle.as_py(), size.as_py(), "zstd", asbytes=True))


_CHANGES = "v_gene string, digest binary, changes array<struct<place:int,residue:string>>"
_CHANGES_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("residue", pa.string())]))


def _changes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each germline of (v_gene, anchor, bundle, size) rows has in place of the anchor's residues, "" where it lacks one; place -1 counts the germline itself."""

    def told(genes: list[str], anchors: list[str], seen: list[str]) -> pa.RecordBatch:
        # letters that score highest with themselves only: such an anchor is aligned with itself letter by letter
        apart = [k for k, (a, s) in enumerate(zip(anchors, seen, strict=True)) if a != s or not _STANDARD.issuperset(s)]
        placed, _ = anchored.align([anchors[k] for k in apart], [seen[k] for k in apart])
        changes: list[list[tuple[int, str]]] = [[(-1, "")] for _ in seen]
        for k, where in zip(apart, placed, strict=True):
            letters, on = _points(anchors[k]), np.flatnonzero(where % 2)
            observed = np.zeros(len(letters), np.uint32)
            observed[where[on] // 2] = _points(seen[k])[on]
            at = np.flatnonzero(letters != observed)
            changes[k] += zip(at.tolist(), [chr(c) if c else "" for c in observed[at].tolist()], strict=True)
        digests = [blake2b(x.encode(), digest_size=16).digest() for x in seen]
        return pa.RecordBatch.from_arrays([pa.array(genes, pa.string()), pa.array(digests, pa.binary()), pa.array(changes, _CHANGES_TYPE)], names=["v_gene", "digest", "changes"])

    for batch in batches:
        genes: list[str] = []
        anchors: list[str] = []
        seen: list[str] = []
        waiting = 0
        for gene, anchor, bundle, size in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
            gene, anchor = gene.as_py(), anchor.as_py()
            for letters in _unpacked(bundle, size):
                genes.append(gene), anchors.append(anchor), seen.append(letters)
                waiting += len(anchor) + len(letters)
                if waiting > TOGETHER:
                    yield told(genes, anchors, seen)
                    genes, anchors, seen, waiting = [], [], [], 0
        if seen:
            yield told(genes, anchors, seen)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The majority of each column of (v_gene, anchor, n, columns) rows; the anchor's own residues have the votes that no change took."""
    for batch in batches:
        genes, anchors, numbers, columns = batch.columns
        out = []
        for anchor, n, changed in zip(anchors, numbers, columns, strict=True):
            letters, n = list(anchor.as_py()), n.as_py()
            for c in changed.as_py():
                own, top = n - c["total"], c["top"]
                if top and (top["votes"] > own or (top["votes"] == own and top["residue"] < letters[c["place"]])):
                    letters[c["place"]] = top["residue"]
                elif not own:
                    letters[c["place"]] = ""
            out.append("".join(letters))
        yield pa.RecordBatch.from_arrays([genes, pa.array(out, pa.string()), numbers], names=["v_gene", "germline_aa", "votes"])


def _changed_columns(rows: DataFrame, germline: str) -> tuple[DataFrame, DataFrame]:
    """(v_gene, anchor), and (v_gene, place, residue, votes) of what its distinct germlines have instead of the anchor's residues; the votes at place -1 are their number.

    Germlines are made once, packed by gene and stored; the anchors are told from that, and after the alignment only
    what differs from the anchor is moved. Equal germlines that were packed apart are told by digest.
    """
    clean = F.upper(F.regexp_replace(germline, "[.-]", ""))
    letters = F.regexp_replace(clean, r"^\s+$", "")
    seen = rows.where("v_gene IS NOT NULL").select(F.col("v_gene").cast("string").alias("v_gene"), letters.alias("seen")).where("seen <> ''")
    bundles = checkpointed(seen.mapInArrow(_bundled, "v_gene string, bundle binary, size long"))
    longest = bundles.mapInArrow(_longest, "v_gene string, anchor string")
    anchors = checkpointed(longest.groupBy("v_gene").agg(F.min_by("anchor", F.struct(-F.length("anchor"), "anchor")).alias("anchor")))
    n, size = anchors.agg(F.count("*"), F.sum(F.octet_length("anchor"))).first()
    if n <= MAX_ROWS and (size or 0) <= MAX_BYTES:
        # the few anchors go to the bundles, which are dealt out, as a gene may have most of them
        paired = bundles.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(anchors), "v_gene")
    else:
        paired = bundles.join(anchors, "v_gene")
    once = paired.select("v_gene", "anchor", "bundle", "size").mapInArrow(_changes_of, _CHANGES).dropDuplicates(["v_gene", "digest"])
    votes = once.select("v_gene", F.explode("changes").alias("c")).groupBy("v_gene", "c.place", "c.residue").agg(F.count("*").alias("votes"))
    return anchors, votes


def column_votes(rows: DataFrame, germline: str = "germline_aa") -> DataFrame:
    """(v_gene, place, residue, votes, n): what the distinct germlines of each gene, ``n`` of them, say in each column of the longest one.

    Letters count in capitals and gaps not at all. Of equally long germlines the
    least is the anchor; a residue that an aligned germline inserts has no column,
    one that it lacks no vote. Rows without a gene or germline have none either.
    A row for each column and residue; ``consensus_germline`` needs only those that differ.
    """
    anchors, votes = _changed_columns(rows, germline)
    number = votes.where("place = -1").select("v_gene", F.col("votes").alias("n"))
    changed = votes.where("place >= 0")
    taken = changed.groupBy("v_gene", "place").agg(F.sum("votes").alias("taken"))
    own = anchors.join(number, "v_gene").select("v_gene", "n", F.posexplode(F.split("anchor", "")).alias("place", "residue")).where("residue <> ''").join(taken, ["v_gene", "place"], "left")
    kept = own.select("v_gene", "place", "residue", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("votes"), "n").where("votes > 0")
    return kept.unionByName(changed.where("residue <> ''").join(number, "v_gene"))


def consensus_germline(rows: DataFrame, min_support: int = 1, germline: str = "germline_aa") -> DataFrame:
    """(v_gene, germline_aa, votes): the majority of each column over the distinct germlines of a gene, where there are at least ``min_support``; of equal residues the least."""
    anchors, votes = _changed_columns(rows, germline)
    order = F.when(F.col("residue") != "", F.struct(-F.col("votes"), "residue"))
    best = votes.groupBy("v_gene", "place").agg(F.sum("votes").alias("total"), F.min_by(F.struct("residue", "votes"), order).alias("top"))
    changed = F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "total", "top")))
    genes = best.groupBy("v_gene").agg(F.max(F.when(F.col("place") < 0, F.col("total"))).alias("n"), changed.alias("columns")).where(F.col("n") >= min_support)
    return genes.join(anchors, "v_gene").select("v_gene", "anchor", "n", "columns").mapInArrow(_spelled, "v_gene string, germline_aa string, votes long")


def align_to_germline(rows: DataFrame, references: DataFrame, numbers: dict[str, list[int | None]] | None = None) -> DataFrame:
    """(v_gene, seq_id, gapped, identity, n_columns) in one column space for each gene.

    ``rows`` has v_gene, seq_id, aa_seq: the picks of a selection, at most a few
    hundred for each gene, as their insertions share columns. Identity counts
    the reference's columns only; a gap is no match.
    """
    joined = rows.select("v_gene", "seq_id", "aa_seq").join(broadcast_within(references.select("v_gene", "germline_aa"), "germline_aa"), "v_gene")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq_id", ignore_index=True)
        gene, ref = group.v_gene[0], group.germline_aa[0]
        top, laid, columns = gotoh.build_columns(ref, group.aa_seq.tolist(), (numbers or {}).get(gene))
        held = [i for i, c in enumerate(columns) if c is not None]
        identity = [sum(row[i] == top[i] for i in held) / max(1, len(held)) for row in laid]
        return pd.DataFrame({"v_gene": gene, "seq_id": group.seq_id, "gapped": laid, "identity": identity, "n_columns": len(top)})

    return joined.groupBy("v_gene").applyInPandas(build, _ALIGNED)


def rows_to_align(pool: DataFrame, rows: int = 50) -> DataFrame:
    """v_gene, seq_id, aa_seq of the first rows of each gene by loop length and id, which an alignment shows; blank sequences among them are left out."""
    place = F.row_number().over(W.Window.partitionBy("v_gene").orderBy(F.asc_nulls_last("cdr3_len"), "seq_id"))
    return pool.select("v_gene", "seq_id", "cdr3_len", "aa_seq").withColumn("_place", place).where(F.col("_place") <= rows).where("trim(aa_seq) <> ''").select("v_gene", "seq_id", "aa_seq")


def with_germline(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(seq_id, germline_aa, aa_seq): rows whose gene has a reference; the references go to every task if their size allows it."""
    known = references.where("germline_aa IS NOT NULL").select("v_gene", "germline_aa")
    return rows.where("aa_seq IS NOT NULL").select("seq_id", "v_gene", "aa_seq").join(broadcast_within(known, "germline_aa"), "v_gene").select("seq_id", "germline_aa", "aa_seq")


def _gapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, seqs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        placed, _ = anchored.align(refs, seqs)
        pairs = [gotoh.gapped(r, s, w) for r, s, w in zip(refs, seqs, placed, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["seq_id", "ref_gapped", "seq_gapped"])


def pairwise_to_germline(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(seq_id, ref_gapped, seq_gapped) for each row by itself: scales with rows, shares no columns."""
    return with_germline(rows, references).mapInArrow(_gapped, "seq_id string, ref_gapped string, seq_gapped string")


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of a batch, of some pairs at a time, as a pair that has little in common has as many as its reference has residues."""
    for batch in (part for b in batches for part in sliced(b, rows=MOST_PAIRS, size=1 << 25)):
        refs, seqs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        placed, _ = anchored.align(refs, seqs)
        at, numbers, old, new, held = [], [], [], [], 0
        for k, (ref, seq, where) in enumerate(zip(refs, seqs, placed, strict=True)):
            letters = _points(ref)
            observed, on = np.full(len(letters), ord(gotoh.GAP), np.uint32), np.flatnonzero(where % 2)
            observed[where[on] // 2] = _points(seq)[on]
            changed = np.flatnonzero(letters != observed)
            at.append(np.full(len(changed), k)), numbers.append(changed + 1), old.append(letters[changed]), new.append(observed[changed])
            held += len(changed)
            if held > MOST_CHANGES or k == len(refs) - 1:
                arrays = [batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(numbers), pa.int32()), _as_letters(np.concatenate(old)), _as_letters(np.concatenate(new))]
                yield pa.RecordBatch.from_arrays(arrays, names=["seq_id", "number", "germline", "observed"])
                at, numbers, old, new, held = [], [], [], [], 0


def germline_changes(paired: DataFrame) -> DataFrame:
    """(seq_id, number, germline, observed) of each reference residue that (seq_id, germline_aa, aa_seq) rows change; a residue that is lacking is observed as '-'.

    Only these are made rows: an alignment never leaves its task. Pairs of long
    sequences that are alike are aligned in the band that provably suffices, the
    others in the whole table; the result is the same. Rows with a null are left
    out, an empty sequence lacks all residues, repeated rows are repeated.
    """
    rows = paired.where("germline_aa IS NOT NULL AND aa_seq IS NOT NULL").select(F.col("seq_id").cast("string").alias("seq_id"), "germline_aa", "aa_seq")
    return rows.mapInArrow(_changed, "seq_id string, number int, germline string, observed string")


def differences(aligned: DataFrame) -> DataFrame:
    """(seq_id, number, germline, observed) of each reference residue that a pairwise alignment changes; gaps are observed as '-'."""
    letters = F.zip_with(F.split("ref_gapped", ""), F.split("seq_gapped", ""), lambda r, s: F.struct(r.alias("r"), s.alias("s")))
    on_ref = F.filter(letters, lambda x: (x["r"] != "-") & (x["r"] != ""))
    each = aligned.select("seq_id", F.posexplode(on_ref).alias("i", "x"))
    return each.where("x.r <> x.s").select("seq_id", (F.col("i") + 1).alias("number"), F.col("x.r").alias("germline"), F.col("x.s").alias("observed"))


def numbered_long(rows: DataFrame, numbering: str = "anarci_numbering") -> DataFrame:
    """(seq_id, region, position, residue) of every numbered residue that is no gap."""
    regions = rows.select("seq_id", F.explode(imgt.parse_numbering(F.col(numbering))).alias("region", "m"))
    return regions.select("seq_id", "region", F.explode("m").alias("position", "residue")).select("seq_id", "region", F.trim("position").alias("position"), "residue").where("residue <> '-'")


def columns_of(long: DataFrame, total: int, min_occupancy: float = 0.0) -> DataFrame:
    """(place, position, region, occupancy) of the positions that rows share, in IMGT order. There are a few hundred positions at most."""
    seen = long.groupBy("position", "region").agg((F.count_distinct("seq_id") / total).alias("occupancy")).where(F.col("occupancy") >= min_occupancy)
    key = imgt.position_key(F.col("position"))
    return seen.withColumn("place", F.row_number().over(W.Window.partitionBy().orderBy(key, "region"))).select("place", "position", "region", "occupancy")


def column_consensus(long: DataFrame) -> DataFrame:
    """(position, residue, votes): the modal residue of each position."""
    return modal(long, ["position"], "residue")
