"""Formats of ``spark.read``: ``repertoire_unit``, ``abif_trace`` and ``plasmid_map``.

    from sparkwell.sources import formats
    formats.register(spark)
    spark.read.format("repertoire_unit").load("/data/units").where("_unit LIKE 'study_a/%'")

Options: ``path`` (a file, or a folder that is gone through with all below it),
``pathGlobFilter`` (names of files), ``bytesPerPartition``, and ``mode`` as with
Spark's own readers: PERMISSIVE gives a damaged row or file what could be read and a
problem, DROPMALFORMED leaves it out, FAILFAST ends the read. A schema that the caller
gives chooses columns: only those are made.

Filters on the name of the file (equal, one of several, beginning with) choose files before
partitions are planned; equality on text columns of units is tested before rows leave
the reader. Hidden files (names that begin with ``_`` or ``.``) are left out; so are empty
units. An empty folder gives no rows.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import struct
import sys
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from . import binary

#: Bytes of a partition, what opening a file is taken to cost, and rows of a batch.
PARTITION_BYTES, OPEN_BYTES, BATCH_ROWS = 64 << 20, 4 << 20, 4096
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


@dataclass(frozen=True)
class Piece:
    """A stretch of a file, by bytes; a file that can't be split is one piece."""

    path: str
    name: str
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]

    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(None)
        self.pieces = pieces


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def listed(path: str, glob: str | None) -> list[tuple[str, str, int]]:
    """(path, name below the root, bytes) of every file, by name."""
    store, root = file_system(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.base_name, info.size)]
    found = []
    for entry in store.get_file_info(pafs.FileSelector(root, recursive=True)):
        name = entry.path[len(root.rstrip("/")) + 1 :]
        hidden = any(part.startswith(("_", ".")) for part in name.split("/"))
        if entry.type == pafs.FileType.File and not hidden and (glob is None or fnmatch.fnmatch(entry.base_name, glob)):
            found.append((entry.path, name, entry.size))
    return sorted(found, key=lambda f: f[1])


def planned(files: Iterable[tuple[str, str, int]], size: int, divisible: bool) -> list[Pieces]:
    """Files in the order of their names, cut where that is possible, put together up to ``size`` bytes."""
    parts, held, room = [], [], size
    for path, name, n in files:
        step = size if divisible and not name.endswith((".gz", ".bz2", ".zst")) else max(n, 1)
        for start in range(0, max(n, 1), step):
            piece = Piece(path, name, start, min(n, start + step))
            cost = piece.end - piece.start + OPEN_BYTES
            if held and cost > room:
                parts.append(Pieces(held))
                held, room = [], size
            held.append(piece)
            room -= cost
    return [*parts, Pieces(held)] if held else parts


class FileReader(DataSourceReader):
    """What the three readers share: options, choice of files, plan, and batches."""

    name_column = "file"
    divisible = False

    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.path, self.glob = options.get("path", ""), options.get("pathGlobFilter")
        if not self.path:
            raise ValueError("a path is needed")
        self.size = int(options.get("bytesPerPartition", PARTITION_BYTES))
        self.mode = options.get("mode", "PERMISSIVE").upper()
        if self.mode not in MODES or self.size < 1:
            raise ValueError(f"mode is one of {', '.join(MODES)}, and a partition has a byte at least")
        self.schema, self.names, self.equal = schema, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what chooses files or rows; Spark tests every filter again."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == self.name_column and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.names.append(f)
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.equal.append((column, f.value))
            yield f

    def chosen(self, name: str) -> bool:
        key = name if self.name_column == "_unit" else name.rsplit("/", 1)[-1]
        return all(key.startswith(f.value) if isinstance(f, StringStartsWith) else key in (f.value if isinstance(f, In) else (f.value,)) for f in self.names)

    def partitions(self) -> list[Pieces]:
        return planned([f for f in listed(self.path, self.glob) if self.chosen(f[1])], self.size, self.divisible)

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        shape, fields = to_arrow_schema(self.schema), self.schema.names
        store = file_system(self.path)[0]
        rows: list[dict] = []
        for piece in partition.pieces if partition else ():
            for row in self.rows(store, piece):
                rows.append({c: row.get(c) for c in fields})
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    def damaged(self, where: str, problem: str) -> bool:
        """Whether the rest of what is damaged is kept."""
        if self.mode == "FAILFAST":
            raise ValueError(f"{where}: {problem}")
        return self.mode == "PERMISSIVE"

    def rows(self, store: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        raise NotImplementedError


def whole(store: pafs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as stream:
        return stream.read()


class TraceReader(FileReader):
    def rows(self, store: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        name = piece.name.rsplit("/", 1)[-1]
        try:
            t = binary.parse_trace(name, whole(store, piece.path))
        except (ValueError, struct.error, IndexError) as error:
            if self.damaged(piece.name, str(error)):
                yield {"file": name, "problem": str(error)}
            return
        yield {**vars(t), "mean_quality": t.mean_quality, "q20": t.bases_at_least(20), "problem": None}


class PlasmidReader(FileReader):
    def rows(self, store: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        name = piece.name.rsplit("/", 1)[-1]
        try:
            p = binary.parse_plasmid(whole(store, piece.path), name)
        except (ValueError, struct.error, IndexError, ElementTree.ParseError) as error:
            if self.damaged(piece.name, str(error)):
                yield {"file": name, "problem": str(error)}
            return
        base = {"file": name, "circular": p.circular, "length": len(p.sequence), "sequence": p.sequence}
        yield from ({**base, "feature": f.name, "kind": f.kind, "start": f.start, "end": f.end, "strand": f.strand, "note": f.note} for f in p.features)
        if not p.features:
            yield base


def cells(line: bytes) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([line.decode("utf-8", "replace").rstrip("\r\n")]), [])


@dataclass
class Head:
    """The first two lines of a unit: its metadata and its columns, and how many bytes both take."""

    meta: dict[str, str]
    columns: list[str]
    size: int


def read_head(stream: io.BufferedReader) -> Head:
    first, second = stream.readline(), stream.readline()
    got = cells(first)
    text = got[0] if len(got) == 1 else first.decode("utf-8", "replace")
    meta = json.loads(text)
    if not isinstance(meta, dict):
        raise ValueError("the first line is no JSON object")
    return Head({k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()}, cells(second), len(first) + len(second))


def opened(store: pafs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(store.open_input_stream(path), 1 << 20)


class UnitReader(FileReader):
    """Lines are rows. A task finds the first line that begins in its stretch, and reads the head of the file for the columns."""

    name_column, divisible = "_unit", True

    def rows(self, store: pafs.FileSystem, piece: Piece) -> Iterator[dict]:
        if piece.end == 0:
            return
        try:
            with opened(store, piece.path) as stream:
                head = read_head(stream)
        except (ValueError, OSError, EOFError) as error:
            if self.damaged(piece.name, str(error)) and piece.start == 0:
                yield {"_unit": piece.name, "_problem": str(error)}
            return
        zipped = piece.name.endswith((".gz", ".bz2", ".zst"))
        base = {"_unit": piece.name, "_meta": list(head.meta.items()), "_problem": None}
        equal = [(head.columns.index(c), v) for c, v in self.equal if c in head.columns]
        try:
            for line in self.lines(store, piece, head, zipped):
                row = cells(line)
                problem = None if len(row) == len(head.columns) else f"{len(row)} cells instead of {len(head.columns)}"
                if problem and not self.damaged(piece.name, problem):
                    continue
                if not all(i < len(row) and row[i] == v for i, v in equal):
                    continue
                yield {**{c: v or None for c, v in zip(head.columns, row, strict=False)}, **base, "_problem": problem}
        except (OSError, EOFError) as error:  # a compressed file that ends early
            if self.damaged(piece.name, str(error)):
                yield {**base, "_problem": str(error)}

    def lines(self, store: pafs.FileSystem, piece: Piece, head: Head, zipped: bool) -> Iterator[bytes]:
        if zipped:
            with opened(store, piece.path) as stream:
                read_head(stream)
                yield from (line for line in stream if line.strip())
            return
        with io.BufferedReader(store.open_input_file(piece.path), 1 << 20) as stream:
            at = max(piece.start, head.size)
            stream.seek(at - 1)
            at += len(stream.readline()) - 1  # the rest of a line that began before; of the head, its line end
            while at < piece.end and (line := stream.readline()):
                at += len(line)
                if line.strip():
                    yield line


class _Files(DataSource):
    reader_class: type[FileReader]

    def reader(self, schema: T.StructType) -> FileReader:
        return self.reader_class(self.options, schema)


class TraceSource(_Files):
    """A row a sequencing trace."""

    reader_class = TraceReader

    @classmethod
    def name(cls) -> str:
        return "abif_trace"

    def schema(self) -> str:
        return binary._TRACE


class PlasmidSource(_Files):
    """A row a feature of a plasmid map; one row for a map without features."""

    reader_class = PlasmidReader

    @classmethod
    def name(cls) -> str:
        return "plasmid_map"

    def schema(self) -> str:
        return f"{binary._FEATURE}, sequence string, problem string"


class UnitSource(_Files):
    """Rows of repertoire units. Columns are those of the first unit that can be read; others are matched to them by name."""

    reader_class = UnitReader

    @classmethod
    def name(cls) -> str:
        return "repertoire_unit"

    def schema(self) -> T.StructType:
        store, columns = file_system(self.options.get("path", ""))[0], []
        for path, _, size in listed(self.options.get("path", ""), self.options.get("pathGlobFilter")):
            try:
                if size:
                    with opened(store, path) as stream:
                        columns = read_head(stream).columns
                    break
            except (ValueError, OSError, EOFError):
                continue
        own = [T.StructField("_unit", T.StringType()), T.StructField("_meta", T.MapType(T.StringType(), T.StringType())), T.StructField("_problem", T.StringType())]
        return T.StructType([*(T.StructField(c, T.StringType()) for c in columns if c not in ("_unit", "_meta", "_problem")), *own])


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TraceSource, PlasmidSource, UnitSource):
        spark.dataSource.register(source)
