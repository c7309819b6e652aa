"""Sanger verification: trimming, reruns, screening, verdicts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import dna, wells
from ..kernels import local, trim
from .spread import broadcast_within, sliced

#: Thresholds of the verdicts.
TRIM_Q, MIN_BP, COVERAGE, IDENTITY, SWAP_MARGIN, MIN_KMERS, MIXED, K = 20, 60, 0.80, 0.90, 1.25, 20, 0.02, 12
#: Scores that a task trims together.
SCORES = 1 << 23
#: Verdicts by severity.
VERDICTS = ("exact", "silent", "missense", "indel", "frameshift", "mixed", "wrong_clone", "no_insert", "low_quality", "unreadable")
USABLE = ("exact", "silent")
#: Ends of a sample's name that mark a rerun, words only after a separator; a bare number does not.
_RERUN = r"(?iU)(?:[-_ .]+(?:rr|rerun|re-?run|repeat|redo|run[2-9]|v[2-9]|r[2-9])|\s*\(\d+\))"


def mott_trim(quality: Column, cutoff: int = TRIM_Q, minimum: int = 20) -> Column:
    """struct(start, end) of the segment with the greatest sum of (limit - error), from 0, end exclusive; (0, 0) if it is short.

    The sum starts anew where it falls below zero; of equal sums the first holds.
    A null array gives null, a null quality in one counts as 0. Traces are gone
    through together, as many as hold so many scores: see ``kernels.trim``.
    """

    @F.arrow_udf("start int, end int")
    def best(arrays: pa.Array) -> pa.Array:
        parts = sliced(pa.RecordBatch.from_arrays([arrays], names=["q"]), rows=1 << 14, size=SCORES)
        ends = [trim.best_segments([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column(0)], cutoff, minimum) for part in parts]
        found = np.concatenate([np.zeros((0, 2), np.int64), *ends]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["start", "end"])

    return F.when(quality.isNotNull(), best(F.transform(quality, lambda q: F.coalesce(q, F.lit(0)))))


def stem_of(name: Column) -> Column:
    """A sample's name without its rerun marks, and the separators around it; a name of marks only keeps the last."""
    strip = lambda s, what: F.regexp_replace(s, f"(?U)^{what}+|{what}+$", "")

    def shorter(s: Column, _: Column) -> Column:
        rest = strip(F.regexp_replace(s, rf"{_RERUN}\s*$", ""), "[ _-]")
        return F.when(rest == "", s).otherwise(rest)

    # a step takes one mark; there are no more than its pattern is found anywhere
    steps = F.sequence(F.lit(0), F.size(F.regexp_extract_all(name, F.lit(_RERUN), F.lit(0))))
    return F.aggregate(steps, strip(name, r"\s"), shorter)


def resolve_reruns(traces: DataFrame, prefer: str = "latest") -> DataFrame:
    """Adds stem, status and a warning: of several traces of a stem, the latest (or the one with most good bases) is kept.

    status is only, kept, superseded or unresolved. A stem with a missing time, or
    with more than one trace at the winning time, is unresolved. ``traces`` has
    file, sample, run_started, q20. A stem has a handful of traces.
    """
    by = F.col("run_started") if prefer == "latest" else F.col("q20")
    named = traces.withColumn("stem", stem_of(F.col("sample"))).withColumn("_by", by)
    stem = W.Window.partitionBy("stem")
    ranked = named.withColumns({"_n": F.count("*").over(stem), "_unknown": F.count_if(F.col("_by").isNull()).over(stem), "_best": F.max("_by").over(stem)})
    ranked = ranked.withColumn("_ties", F.count_if(F.col("_by") == F.col("_best")).over(stem))
    winner_q20 = F.max(F.when(F.col("_by") == F.col("_best"), F.col("q20"))).over(stem)
    status = F.when(F.col("_n") == 1, "only").when((F.col("_unknown") > 0) | (F.col("_ties") > 1), "unresolved").when(F.col("_by") == F.col("_best"), "kept").otherwise("superseded")
    warned = F.when((status == "kept") & (F.max("q20").over(stem) > winner_q20), "a superseded run has more good bases").otherwise("")
    return ranked.withColumns({"status": status, "warning": warned}).drop("_by", "_n", "_unknown", "_best", "_ties")


def expectations_from(clones: DataFrame, context_before: str = "", context_after: str = "", dna_columns: tuple[str, ...] = ("insert_dna_seq", "cds_dna", "insert_dna", "dna", "cds"), order: str = "ordinal") -> DataFrame:
    """(well, clone_id, insert, context): one for each well, the last of several by ``order``; the first DNA column that is there holds the insert.

    The context is the whole contig: the insert between its flanks.
    """
    column = next((c for c in dna_columns if c in clones.columns), None)
    if column is None:
        raise KeyError(f"none of the columns {dna_columns}")
    rows = clones.withColumn("well", wells.normalize(F.col("well"), strict=True))
    last = rows.groupBy("well").agg(F.max_by(F.struct("clone_id", F.upper(column).alias("insert")), order).alias("r"))
    return last.select("well", "r.clone_id", "r.insert", F.concat(F.lit(context_before.upper()), "r.insert", F.lit(context_after.upper())).alias("context"))


def match_traces(traces: DataFrame, expectations: DataFrame, by: str = "well") -> DataFrame:
    """Traces with the expectation of their well; or by sample, whose stem is the clone or begins with it, the longest clone first."""
    if by == "well":
        return traces.join(expectations, "well", "left")
    own = expectations.withColumnRenamed("well", "expected_well")
    # a prefix join by key: every prefix of a stem is looked up among the clones
    prefixes = traces.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("stem"))), lambda i: F.substr(F.col("stem"), F.lit(1), i))).alias("clone_id"))
    hits = prefixes.join(own.select("clone_id"), "clone_id").groupBy("file").agg(F.max_by("clone_id", F.length("clone_id")).alias("clone_id"))
    return traces.join(hits, "file", "left").join(own, "clone_id", "left")


#: k-mers of references that are broadcast; beyond, the join is by shuffle, and k-mers with more than this share of all rows, and so many, are joined apart.
MAX_KMERS, HOT_SHARE, HOT_ROWS = 2_000_000, 1000, 10_000


def _met(own: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of both sides that agree in ``canon``; no task gets all rows of one k-mer of the reads."""
    if known.limit(MAX_KMERS + 1).count() <= MAX_KMERS:
        return own.join(F.broadcast(known), "canon")
    counts = own.groupBy("canon").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(HOT_ROWS, total // HOT_SHARE)).select("canon")  # at most HOT_SHARE of them
    few = broadcast_within(known.join(F.broadcast(hot), "canon", "left_semi"), "ref_kmer")
    return own.join(few, "canon").unionByName(own.join(F.broadcast(hot), "canon", "left_anti").join(known, "canon"))


def screen(reads: DataFrame, references: DataFrame, k: int = K, top: int = 3) -> DataFrame:
    """(read_id, ref_id, shared, strand, place): references by distinct k-mers of the read that they have, the best ``top`` of each read.

    The reverse strand counts only if it shares more. A k-mer and its reverse
    complement have one key, so a read's k-mers are made rows once, and the strand
    is told from which of the two the reference has. Nothing is compared pair by pair.
    """
    turned = dna.reverse_complement(F.col("kmer"))
    keyed = lambda rows: rows.withColumn("canon", F.least("kmer", turned))
    known = keyed(references.select("ref_id", F.explode(dna.distinct_kmers(F.col("seq"), k)).alias("kmer"))).withColumnRenamed("kmer", "ref_kmer")
    own = keyed(reads.select("read_id", F.explode(dna.distinct_kmers(F.col("seq"), k)).alias("kmer")))
    met = _met(own, known)
    counts = met.groupBy("read_id", "ref_id").agg(F.count_if(F.col("kmer") == F.col("ref_kmer")).alias("plus"), F.count_if(turned == F.col("ref_kmer")).alias("minus"))
    shared = F.greatest("plus", "minus")
    place = F.row_number().over(W.Window.partitionBy("read_id").orderBy(F.desc("shared"), "ref_id"))
    ranked = counts.withColumn("shared", shared).select("read_id", "ref_id", "shared", F.when(F.col("plus") >= F.col("minus"), "+").otherwise("-").alias("strand"), place.cast("long").alias("place"))
    return ranked.where(F.col("place") <= max(top, 2))


_CALL = "file string, well string, clone_id string, verdict string, identity double, coverage double, trimmed_bp long, matched string, n_differences long, protein_changes string, confidence double, runner_up string, notes string"


def _protein_changes(insert: str, observed: str) -> list[str]:
    """Residues that differ, by place from 1, without stops at the end; then the lengths if they differ."""
    old, now = (local.translate(x).rstrip("*") for x in (insert, observed))
    found = [f"{x}{i}{y}" for i, (x, y) in enumerate(zip(old, now, strict=False), 1) if x != y]
    return found + ([f"length {len(old)}->{len(now)}"] if len(old) != len(now) else [])


def _events(a: local.Alignment, start: int, end: int) -> list[tuple[str, int, str, str]]:
    """Differences that begin within the insert; each substituted base is one, a run of gaps is one."""
    single = [(kind, at + i, old[i : i + 1], new[i : i + 1]) if kind == "substitution" else (kind, at, old, new) for kind, at, old, new in local.differences(a) for i in range(len(new) if kind == "substitution" else 1)]
    return [e for e in single if start <= e[1] < end]


def _one(row, others: list[tuple[str, str]]) -> tuple:
    """The verdict on one trace by precedence, in the order of ``_CALL``; ``others`` are the inserts of the panel.

    The screen is by inserts alone, as flanks are the same in every well; the alignment is
    against the whole expected contig (the insert if there is none), and only differences
    within the insert count. What was not measured is null.
    """
    seq = row.sequence[row.start : row.end].upper()
    info: dict[str, object] = {}
    notes: list[str] = []

    def call(verdict: str, note: str = "") -> tuple:
        get = info.get
        said = "; ".join([*notes, note] if note else notes)
        return (row.file, row.well, row.clone_id, verdict, get("identity"), get("coverage"), len(seq), get("matched"), get("n"), get("changes", ""), get("confidence"), get("runner_up"), said)

    if len(seq) < MIN_BP:
        return call("low_quality", f"{len(seq)} bp are left after trimming at Q{TRIM_Q}: run it again")
    if not isinstance(row.insert, str) or not row.insert:
        return call("unreadable", "nothing is expected of this well, so the read was not judged")
    insert = row.insert.upper()
    context = row.context.upper() if isinstance(row.context, str) and row.context else insert
    panel = [*(x for x in others if x[0] != row.clone_id), (row.clone_id, insert)]
    shared = local.shared_kmers(seq, [ref for _, ref in panel], K)
    ranked = sorted(((s, i, name) for i, (s, (name, _)) in enumerate(zip(shared, panel, strict=True))), key=lambda x: (-x[0][0], x[1]))[:3]
    mine = next((n for (n, _), _, name in ranked if name == row.clone_id), 0)
    (best, turned), _, leader = ranked[0]
    if best < MIN_KMERS:
        a = local.align_to(context, seq)
        if a is not None and a.identity >= IDENTITY:
            info["identity"] = a.identity
            return call("no_insert", "the vector without the insert")
        return call("unreadable", "neither the insert nor the vector")
    second = next(((n, name) for (n, _), _, name in ranked[1:] if n), (0, ""))
    info.update(matched=leader, runner_up=second[1], confidence=round(1 - second[0] / best, 3))
    if leader != row.clone_id and best >= SWAP_MARGIN * mine:
        a = local.align_to(dict(panel)[leader], dna.complement_of(seq) if turned else seq)
        if a is not None:
            info["identity"] = a.identity
        return call("wrong_clone", f"{best} {K}-mers of {leader}, {mine} of {row.clone_id}")
    query = seq
    if next((r for (_, r), _, name in ranked if name == row.clone_id), False):
        query = dna.complement_of(seq)
        notes.append("reverse strand")
    a = local.align_to(context, query)
    if a is None:
        return call("unreadable", "no alignment with the expected contig")
    start = max(context.find(insert), 0)
    end = start + len(insert)
    events = _events(a, start, end)
    info.update(identity=a.identity, coverage=max(0, min(a.ref_end, end) - max(a.ref_start, start)) / len(insert), n=len(events))
    if info["coverage"] < COVERAGE:
        return call("low_quality", f"{info['coverage']:.0%} of the insert is covered")
    mixed = sum(c in "RYSWKMBDHV" for c in query) / len(query)
    if mixed >= MIXED:
        return call("mixed", f"{mixed:.1%} of the bases are ambiguous: two templates")
    if a.identity < IDENTITY:
        return call("unreadable", f"identity {a.identity:.1%} with the expected contig")
    indels = [e for e in events if e[0] != "substitution"]
    if indels:
        net = sum(len(e[3]) if e[0] == "insertion" else -len(e[2]) for e in indels)
        return call("frameshift" if net % 3 else "indel", f"insertions and deletions: {len(indels)}, net {net:+d} bp")
    if not events:
        return call("exact")
    observed = list(insert)
    for _, at, _, new in events:
        observed[at - start] = new
    changes = _protein_changes(insert, "".join(observed))
    info["changes"] = ";".join(changes)
    return call("missense", ", ".join(changes[:6])) if changes else call("silent", f"silent changes: {len(events)}")


def _all(rows: Iterable, others: list[list[tuple[str, str]]]) -> list[tuple]:
    """The verdicts on traces; those whose trimmed bases, expectation and panel are equal are judged once, as clones of a plate give equal reads."""
    judged: dict[tuple, tuple] = {}
    panels = {id(o): tuple(o) for o in others}  # one panel for all is looked at once
    number: dict[tuple, int] = {}
    of = {k: number.setdefault(p, len(number)) for k, p in panels.items()}
    out = []
    for row, panel in zip(rows, others, strict=True):
        text = lambda x: x if isinstance(x, str) else None
        key = (row.sequence[row.start : row.end].upper(), text(row.clone_id), text(row.insert), text(row.context), of[id(panel)])
        if key not in judged:
            judged[key] = _one(row, panel)
        out.append((row.file, row.well, row.clone_id, *judged[key][3:]))
    return out


#: Clones of a panel that every task is given; traces of a larger one bring the few they could be taken for.
MAX_PANEL = 1536
#: What a call says of its trace besides the verdict.
CARRIED = ("sample", "mean_quality", "run_started")


def call_traces(traces: DataFrame, panel: list[tuple[str, str]] | None) -> DataFrame:
    """A verdict for each matched trace. ``traces`` has file, well, clone_id, sequence, start, end, insert, context.

    ``sample``, ``mean_quality`` and ``run_started`` are carried along if they are there.
    ``panel``: the (clone, insert) of the plate, a few hundred at most; if there is
    none, each trace has its own in an array ``others`` of (place, clone_id, insert).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _CALL.split(", ")]
        for batch in batches:
            own = [[(o["clone_id"], o["insert"]) for o in ([] if x is None else x)] for x in batch["others"]] if panel is None else [panel] * len(batch)
            calls = pd.DataFrame(_all(batch.itertuples(index=False), own), columns=names)
            yield pd.concat([calls, batch[carried].reset_index(drop=True)], axis=1)

    carried = [c for c in CARRIED if c in traces.columns]
    columns = ["file", "well", "clone_id", "sequence", "start", "end", "insert", "context", *carried, *(["others"] if panel is None else [])]
    return traces.select(*columns).mapInPandas(run, ", ".join([_CALL, *(f"{c} {traces.schema[c].dataType.simpleString()}" for c in carried)]))


def verify(traces: DataFrame, expectations: DataFrame, by: str = "well", prefer: str = "latest") -> DataFrame:
    """Reruns resolved, traces matched and called; superseded runs are not called. A trace without scores has a mean quality of 0."""
    mean = F.coalesce(F.aggregate("quality", F.lit(0).cast("long"), lambda t, q: t + F.coalesce(q, F.lit(0))) / F.nullif(F.size("quality"), F.lit(0)), F.lit(0.0))
    trimmed = resolve_reruns(traces, prefer).where("status <> 'superseded'").withColumns({"_trim": mott_trim(F.col("quality")), "mean_quality": mean})
    matched = match_traces(trimmed, expectations, by).select("file", "well", "clone_id", "sequence", F.col("_trim.start").alias("start"), F.col("_trim.end").alias("end"), "insert", "context", *CARRIED)
    panel = [(r["clone_id"], r["insert"]) for r in expectations.select("clone_id", "insert").distinct().limit(MAX_PANEL + 1).collect()]
    if len(panel) <= MAX_PANEL:
        return call_traces(matched, panel)
    # of a larger panel a trace can only be taken for the clones that share most with it: those are looked up by k-mers
    clones = expectations.select(F.col("clone_id").alias("ref_id"), F.col("insert").alias("seq")).where("seq IS NOT NULL").distinct()
    reads = matched.select(F.col("file").alias("read_id"), F.expr("substr(upper(sequence), start + 1, end - start)").alias("seq"))
    near = screen(reads, clones, K, 3).join(clones, "ref_id").groupBy(F.col("read_id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("ref_id").alias("clone_id"), F.col("seq").alias("insert")))).alias("others"))
    return call_traces(matched.join(near, "file", "left"), None)


def summarise(calls: DataFrame) -> DataFrame:
    """(verdict, n, usable, severity)."""
    place = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    return calls.groupBy("verdict").agg(F.count("*").alias("n")).select("verdict", "n", F.col("verdict").isin(*USABLE).alias("usable"), place.alias("severity"))


def usable_wells(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("verdict").isin(*USABLE)).select("well").distinct()
