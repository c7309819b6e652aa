"""Screening texts or reads by k-mers where the references are few and the reads many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import dna
from .spread import sliced, spread

#: k-mers of references that are broadcast; beyond, the join is by shuffle.
MAX_KMERS = 2_000_000


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the number of a k-mer that a table tells of.
BITS = 24


def _folded() -> np.ndarray:
    """The capital of each of the first 128 letters."""
    return np.array([ord(chr(c).upper()) for c in range(128)], np.uint32)


def _numbers(codes: np.ndarray, k: int) -> np.ndarray:
    """A number of ``BITS`` bits for the k letters from each place."""
    out = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for i in range(k):
        out = (out + codes[i : i + len(out)]) * _FACTOR
        out ^= out >> np.uint64(29)
    return (out * _FACTOR >> np.uint64(64 - BITS)).astype(np.int64)


def _likely(words: list[str], k: int):
    """A helper that cuts from (read_id, seq) rows the k letters wherever they may be one of ``words``: all that are and few others.

    Letters beyond ASCII may have capitals of another length; what has one of them always passes.
    """
    table = np.zeros(1 << BITS, bool)
    for w in words:
        if len(w) == k and w.isascii():
            table[_numbers(np.frombuffer(w.encode(), np.uint8).astype(np.uint64), k)] = True
    known = np.packbits(table)
    fold = _folded()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(known).astype(bool)
        for batch in batches:
            for part in sliced(batch, rows=1024, size=1 << 20):
                at: list[int] = []
                found: list[str] = []
                for row, seq in enumerate(part.column(1).to_pylist()):
                    if seq is None or len(seq) < k:
                        continue
                    codes = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
                    odd = codes >= 128
                    likely = there[_numbers(fold[np.where(odd, 0, codes)].astype(np.uint64), k)]
                    if odd.any():
                        total = np.r_[0, np.cumsum(odd)]
                        likely |= total[k:] > total[:-k]
                    words = {seq[i : i + k] for i in np.flatnonzero(likely).tolist()}
                    at += [row] * len(words)
                    found += words
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["read_id", "kmer"])

    return run


def screen_one_strand(reads: DataFrame, references: DataFrame, k: int = 12, top: int = 3) -> DataFrame:
    """(read_id, ref_id, shared, place): the best references of each read by distinct shared k-mers.

    The references' k-mers, if they are few, go to every task, where a table of
    their numbers thins the reads' k-mers before these are made rows; only k-mers that some
    reference has are made distinct and counted.
    """
    known = references.select("ref_id", F.explode(dna.distinct_kmers(F.col("seq"), k)).alias("kmer"))
    words = known.select("kmer").distinct()
    some = words.limit(MAX_KMERS + 1).toArrow().column(0)
    few = len(some) <= MAX_KMERS
    rows = spread(reads.select("read_id", "seq"))
    if few:
        cut = rows.mapInArrow(_likely(some.to_pylist(), k), f"read_id {reads.schema['read_id'].dataType.simpleString()}, kmer string")
        own = cut.select("read_id", F.upper("kmer").alias("kmer"))
    else:
        own = rows.select("read_id", F.explode(dna.kmers(F.col("seq"), k)).alias("x")).select("read_id", F.col("x.kmer").alias("kmer"))
    met = own.join(F.broadcast(words) if few else words, "kmer", "left_semi").distinct()
    shared = met.join(F.broadcast(known) if few else known, "kmer").groupBy("read_id", "ref_id").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.Window.partitionBy("read_id").orderBy(F.desc("shared"), "ref_id"))
    return shared.withColumn("place", place.cast("long")).where(F.col("place") <= top)
