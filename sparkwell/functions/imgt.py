"""IMGT positions: numbering literals, order of positions, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last IMGT number of each region.
REGIONS = (("FR1", 1, 26), ("CDR1", 27, 38), ("FR2", 39, 55), ("CDR2", 56, 65), ("FR3", 66, 104), ("CDR3", 105, 117), ("FR4", 118, 128))
#: The conserved residues on either side of CDR3.
ANCHORS = (104, 118)


def region_of(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, first, last in REGIONS:
        out = F.when(number.between(first, last), F.lit(name)).otherwise(out)
    return out


def parse_numbering(literal: Column) -> Column:
    """map(region -> map(position -> residue)) of a literal with single or double quotes; null where it is none."""
    return F.from_json(F.regexp_replace(literal, "'", '"'), "map<string,map<string,string>>")


def position_key(position: Column) -> Column:
    """struct that sorts positions: by number, then insertion letter, which at 112 runs backwards and before the bare position; junk last."""
    text = F.trim(position)
    number = F.nullif(F.regexp_extract(text, r"^(\d+)([A-Z]*)$", 1), F.lit("")).try_cast("int")
    letter = F.regexp_extract(text, r"^(\d+)([A-Z]*)$", 2)
    code = F.when(letter == "", F.lit(0)).otherwise(F.ascii(letter) - 64)
    rank = F.when(number == 112, -code).otherwise(code)
    return F.struct(F.coalesce(number, F.lit(1_000_000)).alias("number"), F.coalesce(rank, F.lit(0)).alias("rank"), text.alias("text"))
