"""Well names of microplates, their ordinals and plate-shaped dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of each plate format.
FORMATS = {6: (2, 3), 12: (3, 4), 24: (4, 6), 48: (6, 8), 96: (8, 12), 384: (16, 24)}


def dims(plate_format: int) -> tuple[int, int]:
    if plate_format not in FORMATS:
        raise ValueError(f"unknown plate format {plate_format}; known: {sorted(FORMATS)}")
    return FORMATS[plate_format]


def row_index(letter: Column) -> Column:
    """A gives 1; null for anything but one letter."""
    return F.when(F.upper(letter).rlike("^[A-Z]$"), F.ascii(F.upper(letter)) - 64)


def row_label(index: Column) -> Column:
    return F.char(F.lit(64) + index)


def _pattern(plate_format: int) -> str:
    rows, cols = dims(plate_format)
    return f"^[A-{chr(64 + rows)}](?:{'|'.join(f'{c:02d}' for c in range(1, cols + 1))})$"


def from_rc(row: Column, col: Column, plate_format: int = 96) -> Column:
    """Letter and two-digit number; null outside the plate."""
    rows, cols = dims(plate_format)
    return F.when(row.between(1, rows) & col.between(1, cols), F.concat(row_label(row), F.lpad(col.cast("string"), 2, "0")))


def normalize(raw: Column, plate_format: int = 96, strict: bool = False) -> Column:
    """The well as A01, however it is written: a1, ' A 01 ', 1A. What is no well of the plate gives null, or an error if ``strict``."""
    plain = F.upper(F.regexp_replace(raw, r"\s", ""))
    letter_first = F.regexp_replace(plain, "^([0-9]+)([A-Z])$", "$2$1")
    two_digits = F.regexp_replace(F.regexp_replace(letter_first, "^([A-Z])0*([1-9][0-9])$", "$1$2"), "^([A-Z])0*([0-9])$", "$10$2")
    # the first match or null: the long expression stands once
    well = F.try_element_at(F.regexp_extract_all(two_digits, F.lit(_pattern(plate_format)), F.lit(0)), F.lit(1))
    if strict:
        return F.when(raw.isNotNull() & well.isNull(), F.raise_error(F.concat(F.lit("no well of the plate: "), raw))).otherwise(well)
    return well


def to_rc(raw: Column, plate_format: int = 96) -> Column:
    """struct(row, col), both from 1; nulls if it is no well of the plate."""
    well = normalize(raw, plate_format)
    return F.struct((F.ascii(well) - 64).alias("row"), F.substring(well, 2, 2).cast("int").alias("col"))


def short(well: Column) -> Column:
    """A01 as A1."""
    return F.regexp_replace(well, "^([A-P])0*", "$1")


def column_major(well: Column, plate_format: int = 96) -> Column:
    """Place from 1, down the columns."""
    rc = to_rc(well, plate_format)
    return (rc["col"] - 1) * dims(plate_format)[0] + rc["row"]


def row_major(well: Column, plate_format: int = 96) -> Column:
    """Place from 1, along the rows."""
    rc = to_rc(well, plate_format)
    return (rc["row"] - 1) * dims(plate_format)[1] + rc["col"]


def at_column_major(place: Column, plate_format: int = 96) -> Column:
    """The well at a place from 1, down the columns."""
    rows, _ = dims(plate_format)
    zero = place - 1
    return from_rc((zero % rows + 1).cast("int"), (F.floor(zero / rows) + 1).cast("int"), plate_format)


def at_row_major(place: Column, plate_format: int = 96) -> Column:
    _, cols = dims(plate_format)
    zero = place - 1
    return from_rc((F.floor(zero / cols) + 1).cast("int"), (zero % cols + 1).cast("int"), plate_format)


def is_edge(well: Column, plate_format: int = 96) -> Column:
    rows, cols = dims(plate_format)
    rc = to_rc(well, plate_format)
    return rc["row"].isin(1, rows) | rc["col"].isin(1, cols)


def all_wells(spark: SparkSession, plate_format: int = 96) -> DataFrame:
    """(well, row, col, place_down, place_along) of every well of the format."""
    rows, cols = dims(plate_format)
    grid = spark.range(rows * cols).select((F.col("id") % rows + 1).cast("int").alias("row"), (F.floor(F.col("id") / rows) + 1).cast("int").alias("col"))
    down, along = (F.col("col") - 1) * rows + F.col("row"), (F.col("row") - 1) * cols + F.col("col")
    return grid.select(from_rc(F.col("row"), F.col("col"), plate_format).alias("well"), "row", "col", down.cast("int").alias("place_down"), along.cast("int").alias("place_along"))


def matrix(values: DataFrame, column: str, plate_format: int = 96, samples_only: bool = True, plate: str = "plate_id") -> DataFrame:
    """Plate, row and a column for each number of the plate: readings as they stand, nulls where there is none or no sample."""
    rows, cols = dims(plate_format)
    rc = to_rc(F.col("well"), plate_format)
    shown = F.when(F.col("role") == "sample", F.col(column)) if samples_only else F.col(column)
    named = values.select(F.col(plate), row_label(rc["row"]).alias("row"), rc["col"].alias("_c"), shown.alias("_v"))
    return named.groupBy(plate, "row").pivot("_c", list(range(1, cols + 1))).agg(F.first("_v", ignorenulls=True))
