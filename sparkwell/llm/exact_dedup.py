"""Exact deduplication through counting quotient filters.

1. Each document gets a 64-bit fingerprint; each partition builds counting
   quotient filters of its fingerprints, one for each range of fingerprints.
2. The filters of one range merge losslessly: their slots are read off in the
   order of quotient and remainder, and equal ones add their counts.
3. Documents whose fingerprint counts more than one go to byte verification:
   their texts are grouped as whole byte strings. The rest are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, broadcast_if_small, clean_text, is_small, lookup, matching, perhaps_in

#: Fingerprints that a merged range holds on average.
RANGE_FINGERPRINTS = 250_000


@dataclass
class QuotientFilter:
    """A counting quotient filter of ``bits``-bit keys: ``1 << q`` home slots and an overflow tail.

    ``occupied[h]`` says that home slot h has a run; ``run_end[s]`` that slot s is
    the last of its run; a slot holds a remainder and, beside it, its count.
    ``used[s]`` marks filled slots. Keys are the low ``bits`` bits.
    """

    q: int
    bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    used: np.ndarray
    remainder: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> QuotientFilter:
        """From keys in any order, repeats allowed; counts default to one each."""
        keys = np.asarray(keys, np.uint64)
        counts = np.ones(len(keys), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        distinct = keys[first]
        q = min(bits, max(3, int(np.ceil(np.log2(len(distinct) / 0.75 + 1)))))  # load of at most 3/4
        r = np.uint64(bits - q)
        home = (distinct >> r).astype(np.int64) if q < bits else distinct.astype(np.int64)
        rest = distinct & ((np.uint64(1) << r) - np.uint64(1))
        # each item stands in its home slot or right after the item before it
        index = np.arange(len(home))
        slot = index + np.maximum.accumulate(home - index) if len(home) else home
        size = max(1 << q, int(slot[-1]) + 1 if len(slot) else 0)
        occupied, run_end, used = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[home], used[slot], remainder[slot], count[slot] = True, True, rest, totals
        if len(home):
            run_end[slot[np.r_[home[1:] != home[:-1], True]]] = True
        return cls(q, bits, occupied, run_end, used, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, with their counts: the k-th run belongs to the k-th occupied home slot."""
        filled = np.flatnonzero(self.used)
        ends = self.run_end[filled]
        run = np.cumsum(ends) - ends
        home = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        keys = (home << np.uint64(self.bits - self.q)) | self.remainder[filled] if self.q < self.bits else home
        return keys, self.count[filled]

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        """Lossless: nothing is estimated, equal quotients and remainders add their counts."""
        parts = [f.items() for f in filters]
        return QuotientFilter.build(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]), filters[0].bits)

    def to_row(self) -> dict:
        filled = np.flatnonzero(self.used)
        return {
            "q": self.q,
            "slots": len(self.used),
            "occupied": np.packbits(self.occupied).tobytes(),
            "used": np.packbits(self.used).tobytes(),
            "run_end": np.packbits(self.run_end).tobytes(),
            "remainders": self.remainder[filled].tobytes(),
            "counts": self.count[filled].tobytes(),
        }

    @classmethod
    def from_row(cls, row: dict, bits: int) -> QuotientFilter:
        unpack = lambda x, n: np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
        used = unpack(row["used"], row["slots"])
        remainder, count = np.zeros(row["slots"], np.uint64), np.zeros(row["slots"], np.int64)
        remainder[used], count[used] = np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64)
        return cls(row["q"], bits, unpack(row["occupied"], 1 << row["q"]), unpack(row["run_end"], row["slots"]), used, remainder, count)


_FILTER = "range int, q int, slots int, occupied binary, used binary, run_end binary, remainders binary, counts binary"


def _arrow_rows(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


_FIELDS = [("range", pa.int32()), ("q", pa.int32()), ("slots", pa.int32()), *((n, pa.binary()) for n in ("occupied", "used", "run_end", "remainders", "counts"))]


def _filters_of_partition(range_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        if not len(keys):
            return
        where = (keys >> np.uint64(64 - range_bits)).astype(np.int64)
        low = keys & np.uint64((1 << (64 - range_bits)) - 1)
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        rows = []
        for i, j in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            rows.append({"range": int(where[i])} | QuotientFilter.build(low[i:j], bits=64 - range_bits).to_row())
            if len(rows) >= 64:
                yield _arrow_rows(rows, _FIELDS)
                rows = []
        if rows:
            yield _arrow_rows(rows, _FIELDS)

    return build


def _merged(range_bits: int, least: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bits = 64 - range_bits
        keys, counts = QuotientFilter.merge([QuotientFilter.from_row(r, bits) for r in rows]).items()
        keep = counts >= least
        whole = (np.uint64(rows[0]["range"]) << np.uint64(bits)) | keys[keep]
        return pa.table({"fp": pa.array(whole.view(np.int64)), "fp_count": pa.array(counts[keep])})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, total: int, least: int = 2) -> DataFrame:
    """(fp, fp_count) of the 64-bit fingerprints that occur at least ``least`` times.

    ``fingerprints`` has one long column. A partition sends each distinct
    fingerprint once, whatever the number of its copies, so a hot fingerprint
    costs one slot a partition.
    """
    range_bits = min(24, max(6, int(np.ceil(np.log2(max(1, total / RANGE_FINGERPRINTS))))))
    filters = fingerprints.mapInArrow(_filters_of_partition(range_bits), _FILTER)
    return filters.groupBy("range").applyInArrow(_merged(range_bits, least), "fp long, fp_count long")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty, and empty
    texts form a group like any other. The row with the largest key stays; if
    rows repeat key and text, one of them stays. A null key is smaller than any.
    The texts of repeated fingerprints are grouped with partial aggregation, so
    each map task ships a text once; everything else moves narrow rows. Columns
    of other names are ignored; an empty table gives no row. Tables that the result
    reads are in ``scratch``, which a caller may close once it has been read.
    """
    return _exact(scratch or Scratch(docs.sparkSession, "exact-dedup"), docs, key, text)[0]


def _exact(scratch: Scratch, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The result of ``exact_duplicates`` and the number of its rows."""
    body = clean_text(text)
    fingerprint = F.xxhash64(body)
    narrow = docs.select(F.col(key).alias("_id"), fingerprint.alias("fp"), F.unhex(F.sha2(body, 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    narrow = scratch.store(narrow, "fingerprints")
    total = narrow.count()
    repeated = scratch.store(repeated_fingerprints(narrow.select("fp"), total), "repeated")
    # byte verification: the whole text is the grouping key
    suspects = matching(docs.select(fingerprint.alias("fp"), body.alias("body")), repeated, "fp", total, "fp_count")
    same_bytes = suspects.groupBy("body").agg(F.count("*").alias("n"))
    verified = same_bytes.where("n > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "n")
    stays = matching(narrow, repeated, "fp", total, "fp_count").groupBy("sha").agg(F.max(F.struct("_id", "row")).alias("stays"))
    groups = scratch.store(verified.join(stays, "sha"), "groups", rows=total)
    scratch.drop(repeated)
    out = lookup(narrow, groups, "sha", total)
    out = out.select(
        F.col("_id").alias(key),
        F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("stays._id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out, total


def keep_marked(scratch: Scratch, docs: DataFrame, marked: DataFrame, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (key, text_sha256) is ``kept`` in ``marked``, all their columns; of rows that repeat both, one.

    Of ``scratch`` only the marks stay: the keys and digests of rows that go or that repeat both.
    """
    seen = marked.groupBy(F.col(key).alias("_id"), F.unhex("text_sha256").alias("_sha"))
    marks = scratch.store(seen.agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")).where("NOT _kept OR _rows > 1"), "marks", rows=total)
    scratch.keep_only(marks)
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.unhex(F.sha2(clean_text(text), 256)).alias("_text"))
    on = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha"))
    gone, twice = (broadcast_if_small(marks.where(w)) for w in ("NOT _kept", "_kept"))
    if is_small(marks):
        keep = rows.join(gone, on, "left_anti")
    else:  # rows that are surely not marked stay where they are
        marked = perhaps_in(rows, marks, [F.col("_key"), F.col("_text")], ["_id", "_sha"], "_hit")
        keep = marked.where("NOT _hit").drop("_hit").unionByName(marked.where("_hit").drop("_hit").join(gone, on, "left_anti"))
    if marks.where("_kept").isEmpty():
        return keep.select("_row.*")
    once = keep.join(twice, on, "left_anti").select("_row")
    first = keep.join(twice, on, "left_semi").groupBy("_key", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(first).select("_row.*")


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all their columns: one row of each group of equal texts.

    A null text counts as empty, a null key is smaller than any; of rows that repeat
    key and text one stays. Columns of any other name are kept. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    return keep_marked(scratch, docs, *_exact(scratch, docs, key, text), key, text)
