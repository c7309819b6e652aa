"""Plate readers' exports: plate-shaped blocks found by their shape, and long tables."""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wells
from ..registry import Registry

#: Cells that stand for a reading above the range.
OVERFLOW = ("OVRFLW", "OVER", "SATURATED", "*****")
LEAST_COLUMNS, LEAST_ROWS, PREAMBLE = 6, 4, 6
READERS: Registry[Callable[..., DataFrame]] = Registry("reader")


def reading(cell: Column) -> Column:
    """The number in a cell: infinity for an overflow mark, null for a blank or other text."""
    text = F.trim(cell)
    return F.when(F.upper(text).isin(*OVERFLOW), F.lit(float("inf"))).otherwise(text.try_cast("double"))


def _number(cell: str) -> float | None:
    text = cell.strip()
    if text.upper() in OVERFLOW:
        return math.inf
    try:
        return float(text)
    except ValueError:
        return None


@dataclass
class Grid:
    sheet: str
    place: int
    values: dict[str, float]
    preamble: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join([self.sheet, *self.preamble])


def _header(row: list[str]) -> tuple[int, int] | None:
    """(first cell, columns) of the longest run 1, 2, 3, ... of a row, if it is long enough."""
    best = None
    for i, cell in enumerate(row):
        if cell.strip() in ("1", "1.0"):
            n = 1
            while i + n < len(row) and row[i + n].strip() in (str(n + 1), f"{n + 1}.0"):
                n += 1
            if n >= LEAST_COLUMNS and (best is None or n > best[1]):
                best = (i, n)
    return best


def find_grids(rows: list[list[str]], sheet: str = "") -> list[Grid]:
    """Every block of a header 1, 2, 3, ... with row letters below, wherever it stands; up to six lines above it are kept."""
    out, y = [], 0
    while y < len(rows):
        found = _header(rows[y])
        if found is None:
            y += 1
            continue
        left, n = found
        height = 0
        while y + height + 1 < len(rows) and left and len(rows[y + height + 1]) >= left and rows[y + height + 1][left - 1].strip().upper() == chr(65 + height):
            height += 1
        if height >= LEAST_ROWS:
            cells = {f"{chr(65 + r)}{c + 1:02d}": v for r in range(height) for c in range(n) if left + c < len(rows[y + 1 + r]) and (v := _number(rows[y + 1 + r][left + c])) is not None}
            above = [" ".join(x.strip() for x in line if x.strip()) for line in rows[max(0, y - PREAMBLE) : y]]
            out.append(Grid(sheet, len(out), cells, [a for a in above if a]))
        y += height + 1
    return out


_WELLS = "file string, grid int, text string, well string, od450 double"


@READERS.register("grid_csv", confidence="verified")
def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(file, grid, text, well, od450) of every block of CSV files, a task for each few files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content, strict=True):
                cells = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                for g in find_grids(cells, name.rsplit("/", 1)[-1]):
                    rows += [(g.sheet, g.place, g.text, w, v) for w, v in g.values.items()]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _WELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _WELLS)


@READERS.register("long_csv", confidence="verified")
def read_long(spark: SparkSession, path: str, well: str = "well", value: str = "od450", plate: str | None = None, plate_format: int = 96) -> DataFrame:
    """(plate, well, od450) of a table with a row for each well."""
    rows = spark.read.option("header", "true").csv(path)
    if missing := [c for c in (well, value, plate) if c and c not in rows.columns]:
        raise KeyError(f"columns are missing: {missing}")
    return rows.select(F.col(plate).alias("plate") if plate else F.lit("").alias("plate"), wells.normalize(F.col(well), plate_format, strict=True).alias("well"), reading(F.col(value)).alias("od450"))


def read(spark: SparkSession, path: str, reader: str, allow_unverified: bool = False, **options) -> DataFrame:
    """By the reader's name; one that was never held against a real file must be allowed."""
    if READERS.meta(reader).get("confidence") != "verified" and not allow_unverified:
        raise ValueError(f"reader {reader} is unverified")
    return READERS.get(reader)(spark, path, **options)
