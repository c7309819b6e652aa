"""Order tables of gene-fragment vendors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.construct import Limits, vendor_issues
from ..registry import Registry

VENDORS: Registry[Callable[..., DataFrame]] = Registry("vendor")


@VENDORS.register("generic", confidence="verified", limits=None)
def generic(clones: DataFrame, name: str = "insert_name", seq: str = "order_dna_seq") -> DataFrame:
    return clones.select(F.col(name).alias("name"), F.col(seq).alias("sequence"), F.length(seq).cast("long").alias("length"), F.round(dna.gc_fraction(F.col(seq)), 3).alias("gc"))


@VENDORS.register("idt_eblocks", confidence="verified", limits=Limits())
def idt_eblocks(clones: DataFrame, name: str = "insert_name", seq: str = "order_dna_seq") -> DataFrame:
    return clones.select(F.col(name).alias("Name"), F.col(seq).alias("Sequence"))


def summary(clones: DataFrame, vendor: str, name: str = "insert_name", seq: str = "order_dna_seq") -> DataFrame:
    """One row: fragments, bases, issues and how many fragments have any."""
    limits = VENDORS.meta(vendor)["limits"]
    issues = vendor_issues(clones, limits, name, seq) if limits else clones.select(F.col(name).alias("name"), F.lit("").alias("issue")).limit(0)
    told = issues.agg(F.count("*").alias("issues"), F.count_distinct("name").alias("failing"))
    return clones.agg(F.count("*").alias("fragments"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).cast("long").alias("bases")).join(told, how="cross")  # one row each


def emit(clones: DataFrame, vendor: str, allow_unverified: bool = False, **columns: str) -> DataFrame:
    if VENDORS.meta(vendor)["confidence"] != "verified" and not allow_unverified:
        raise ValueError(f"the template of {vendor} is not verified")
    return VENDORS.get(vendor)(clones, **columns)
