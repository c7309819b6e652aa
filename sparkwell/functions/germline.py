"""Gene calls: ties, genes, families, alleles, chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_calls(call: Column) -> Column:
    """The calls of a comma-separated tie, trimmed, blanks dropped; null gives an empty array."""
    parts = F.filter(F.transform(F.split(call, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def top_call(call: Column) -> Column:
    """The first call; null if there is none."""
    return F.try_element_at(split_calls(call), F.lit(1))


def gene(call: Column) -> Column:
    """The first call without its allele."""
    return F.substring_index(top_call(call), "*", 1)


def allele(call: Column) -> Column:
    """What follows the star of the first call; null if it has none."""
    top = top_call(call)
    return F.when(F.contains(top, F.lit("*")), F.substr(top, F.instr(top, "*") + 1))


def family(call: Column) -> Column:
    """Locus, segment and family number, such as IGHV3; null where the call has no such form."""
    return F.nullif(F.regexp_extract(top_call(call), r"^(IG[HKL][VDJ]\d+)", 1), F.lit(""))


def chain_of(call: Column) -> Column:
    """H or L by the third letter of the first call; null if it is shorter."""
    top = top_call(call)
    return F.when(F.length(top) >= 3, F.when(F.substring(top, 3, 1) == "H", "H").otherwise("L"))


def identity(a: Column, b: Column) -> Column:
    """One minus edit distance over the greater length; two empty sequences are identical."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def distance(a: Column, b: Column) -> Column:
    return 1 - identity(a, b)


def status_flags(status: Column) -> Column:
    """The flags of a bar-separated status, trimmed, blanks dropped; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(F.split(status, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


#: Flags with one of these are about read coverage, not about the molecule.
COVERAGE_PATTERNS = ("shorter than imgt defined", "deletions:")


def is_coverage_flag(flag: Column, patterns: tuple[str, ...] = COVERAGE_PATTERNS) -> Column:
    low = F.lower(flag)
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(low, F.lit(p))
    return out


def has_liability(status: Column, patterns: tuple[str, ...] = COVERAGE_PATTERNS) -> Column:
    """Whether a status has a flag that is not about coverage; unknown flags count."""
    return F.exists(status_flags(status), lambda x: ~is_coverage_flag(x, patterns))


def ambiguous_residues(aa: Column) -> Column:
    """Number of characters that are none of the twenty residues."""
    return F.regexp_count(aa, F.lit("[^ACDEFGHIKLMNPQRSTVWY]"))


def ungapped(aligned: Column) -> Column:
    return F.regexp_replace(aligned, "[-.]", "")
