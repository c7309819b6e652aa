"""Workbooks (xlsx): cells of every sheet, without another library; and a writer for files of a plate reader's shape."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from ..functions.wells import dims
from .grids import _WELLS, READERS, find_grids

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of texts) of each sheet, in the order of the workbook; blank cells are empty texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        text_of = lambda x: "".join(t.text or "" for t in x.iter(f"{_MAIN}t"))
        shared = [text_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_RELATION)]
            rows: dict[int, dict[int, str]] = {}
            for cell in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}c"):
                at = regex.match(r"([A-Z]+)([0-9]+)", cell.get("r"))
                value = cell.find(f"{_MAIN}v")
                kind = cell.get("t")
                text = text_of(cell) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
                rows.setdefault(int(at[2]), {})[_column(at[1])] = text
            width = max((max(r) for r in rows.values()), default=0)
            out.append((sheet.get("name"), [[rows.get(y, {}).get(x, "") for x in range(1, width + 1)] for y in range(1, max(rows, default=0) + 1)]))
    return out


@READERS.register("biotek_gen5", confidence="sketch")
def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, grid, text, well, od450) of every grid of every sheet of workbooks, a task for each few files; grids are counted through a file's sheets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content, strict=True):
                found = [g for sheet, cells in read_sheets(bytes(content)) for g in find_grids(cells, sheet)]
                rows += [(name.rsplit("/", 1)[-1], i, g.text, w, v) for i, g in enumerate(found) for w, v in g.values.items()]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _WELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _WELLS)


def write_workbook(path: str | Path, plates: list[tuple[str, dict[str, float]]], plate_format: int = 96, preamble: bool = True) -> Path:
    """A workbook of the shape of a plate reader's export, made up: a sheet for each (name, readings by well), some lines of text, then the grid, not in the first column."""
    rows, cols = dims(plate_format)

    def cell(x: int, y: int, value: object) -> str:
        at = f'r="{_letters(x)}{y}"'
        return f'<c {at} t="inlineStr"><is><t>{escape(value)}</t></is></c>' if isinstance(value, str) else f"<c {at}><v>{value!r}</v></c>"

    def sheet(name: str, readings: dict[str, float]) -> str:
        lines = [["Plate Number", name], ["Read 450"], []] if preamble else []
        left = 2 if preamble else 1
        grid = [[*[""] * left, *range(1, cols + 1)], *([*[""] * (left - 1), chr(65 + r), *(readings.get(f"{chr(65 + r)}{c:02d}", "") for c in range(1, cols + 1))] for r in range(rows))]
        made = [f'<row r="{y}">' + "".join(cell(x, y, v) for x, v in enumerate(line, 1) if v != "") + "</row>" for y, line in enumerate([*lines, *grid], 1)]
        return f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(made)}</sheetData></worksheet>'

    titles = [regex.sub(r"[\[\]:*?/\\]", "_", name)[:31] for name, _ in plates]
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="w" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(plates) + 1)) + "</Relationships>",
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="s{i}"/>' for i, t in enumerate(titles, 1)) + "</sheets></workbook>",
        **{f"xl/worksheets/sheet{i}.xml": sheet(name, readings) for i, (name, readings) in enumerate(plates, 1)},
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return Path(path)
