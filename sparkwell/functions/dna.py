"""DNA: complements, composition, translation, k-mers, restriction sites."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Complements of the IUPAC letters, either case.
_IUPAC, _COMPLEMENT = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
#: Recognition sites.
ENZYME_SITES = {"BsaI": "GGTCTC", "BsmBI": "CGTCTC", "Esp3I": "CGTCTC", "BbsI": "GAAGAC", "SapI": "GCTCTTC"}
#: Fixed value: residues of the codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG of the standard code.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def complement_of(site: str) -> str:
    return site.translate(str.maketrans(_IUPAC, _COMPLEMENT))[::-1]


def reverse_complement(seq: Column) -> Column:
    """Of any IUPAC letters; case stays, other characters too."""
    return F.reverse(F.translate(seq, _IUPAC, _COMPLEMENT))


def gc_fraction(dna: Column) -> Column:
    """Share of G and C; 0 for the empty sequence."""
    return F.when(F.length(dna) == 0, F.lit(0.0)).otherwise(F.regexp_count(dna, F.lit("[GC]")) / F.length(dna))


def codons(dna: Column) -> Column:
    """Whole codons in order; what is left at the end is not one."""
    return F.regexp_extract_all(dna, F.lit("(?s)..."), F.lit(0))


def translate(dna: Column) -> Column:
    """Residues of the codons, with a star for a stop and X for what is no codon."""
    return F.arrow_udf(_translated, T.StringType())(dna)


#: A number for each byte, 4 for what is no base; and the residue of three of them.
_BASE = np.full(256, 4, np.uint8)
_BASE[[ord(b) for b in "TCAG"]] = range(4)
_RESIDUE = np.full((5, 5, 5), ord("X"), np.uint8)
_RESIDUE[:4, :4, :4] = np.frombuffer(_CODE.encode(), np.uint8).reshape(4, 4, 4)


def _translated(sequences: pa.Array) -> pa.Array:
    """One byte for each character, so that three are a codon; evaluated once, however often an expression names it."""

    def residues(text: str) -> str:
        codes = _BASE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)[: len(text) // 3 * 3]].reshape(-1, 3)
        return _RESIDUE[codes[:, 0], codes[:, 1], codes[:, 2]].tobytes().decode()

    return pa.array((residues(x.as_py()) if x.is_valid else None for x in sequences), pa.string())


def homopolymers(dna: Column, limit: int = 6) -> Column:
    """Runs of one base of ``limit`` or more, in order."""
    return F.regexp_extract_all(dna, F.lit("(" + "|".join(f"{b}{{{limit},}}" for b in "ACGT") + ")"), F.lit(1))


def sites_to_avoid(enzymes: list[str]) -> list[str]:
    """The sites of enzymes and their reverse complements, each once."""
    unknown = [e for e in enzymes if e not in ENZYME_SITES]
    if unknown:
        raise KeyError(f"unknown enzymes: {unknown}")
    return list(dict.fromkeys(s for e in enzymes for s in (ENZYME_SITES[e], complement_of(ENZYME_SITES[e]))))


def internal_sites(dna: Column, enzymes: list[str]) -> Column:
    """Which of the sites a sequence has."""
    return F.filter(F.array(*[F.lit(s) for s in sites_to_avoid(enzymes)]), lambda s: F.contains(dna, s))


def kmers(seq: Column, k: int, stretch: int = 256) -> Column:
    """array of struct(kmer, position from 0) of the upper-case sequence; k-mers with N are left out, other ambiguity codes are not.

    The sequence is cut into overlapping stretches first: taking a substring costs
    its position, so that one pass over a long sequence would cost its square.
    """
    last = F.length(seq) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stretch)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("s"), F.substr(seq, s + 1, F.lit(stretch + k - 1)).alias("t")))
    inside = lambda c: F.transform(F.sequence(F.lit(0), F.length(c["t"]) - k), lambda j: F.struct(F.upper(F.substr(c["t"], j + 1, F.lit(k))).alias("kmer"), (c["s"] + j).alias("position")))
    whole = F.coalesce(F.flatten(F.transform(cut, inside)), F.array().cast("array<struct<kmer:string,position:int>>"))
    return F.filter(whole, lambda x: ~F.contains(x["kmer"], F.lit("N")))


def distinct_kmers(seq: Column, k: int) -> Column:
    return F.array_distinct(F.transform(kmers(seq, k), lambda x: x["kmer"]))


def shared_kmers(query: Column, reference: Column, k: int) -> Column:
    """Number of distinct k-mers of the query that the reference has."""
    return F.size(F.array_intersect(distinct_kmers(query, k), distinct_kmers(reference, k)))


def circular_slice(seq: Column, start: Column, end: Column) -> Column:
    """From ``start`` to ``end`` (from 0, end exclusive) of a circular sequence; an end at or before the start goes over the origin."""
    size = F.length(seq)
    length = F.when(end > start, end - start).otherwise(size - start + end)
    return F.substr(F.concat(seq, seq), start + 1, length)


def mixed_fraction(seq: Column) -> Column:
    """Share of IUPAC ambiguity codes; 0 for the empty sequence. N is not one of them."""
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(F.regexp_count(F.upper(seq), F.lit("[RYSWKMBDHV]")) / F.length(F.upper(seq)))


def protein_changes(expected: Column, observed: Column) -> Column:
    """Changes such as A12T, then ``length N->M`` if the lengths differ."""
    pairs = F.zip_with(F.split(expected, ""), F.split(observed, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    named = F.transform(pairs, lambda x, i: F.when((x["a"] != x["b"]) & (x["a"] != "") & (x["b"] != ""), F.concat(x["a"], (i + 1).cast("string"), x["b"])))
    changes = F.filter(named, lambda x: x.isNotNull())
    sizes = F.concat(F.lit("length "), F.length(expected).cast("string"), F.lit("->"), F.length(observed).cast("string"))
    return F.when(F.length(expected) == F.length(observed), changes).otherwise(F.concat(changes, F.array(sizes)))
