"""Repertoire units: metadata, header, rows. Each task writes a unit of its own, so nothing is shuffled."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _line(cells: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def write_units(rows: DataFrame, path: str, meta: dict[str, str], mode: str = "errorifexists") -> None:
    """A folder of units, which ``repertoire_unit`` reads. Nulls are empty cells; line breaks in a cell become spaces.

    An empty partition gives a unit without rows. Columns are written as Spark casts them to strings.
    """
    head = [_line([json.dumps(meta)]), _line(rows.columns)]
    text = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\r\n]+", " "), F.lit("")).alias(c) for c in rows.columns]
    cell = lambda c: F.when(F.col(f"`{c}`").rlike('[",]'), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(f"`{c}`"))
    lines = rows.select(*text).select(F.concat_ws(",", *map(cell, rows.columns)).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": head})
        yield from (pa.RecordBatch.from_arrays([b.column(0)], names=["value"]) for b in batches)  # as nullable as the head

    lines.mapInArrow(headed, "value string").write.mode(mode).text(path)
