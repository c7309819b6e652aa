"""Web archives as a chunked record table.

``write_archives`` writes WARC/1.1 files, one gzip member a record, with revisit
records for payloads that another record holds. ``read_chunks`` streams such
files into rows of (record, chunk number), each with the digest of the payload so
far, so that no record is ever held whole: a task's memory is one chunk and the
inflater's window, however large the payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, is_small, lookup, materialize, perhaps_in, scratch_path

CHUNK_BYTES = 64 << 10
ARCHIVE_BYTES = 1 << 30
#: Payloads below this are always written in full.
REVISIT_BYTES = 1000
#: The profile URI that WARC/1.1 gives for revisits of identical payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

_MANIFEST = "archive string, records long, bytes long"
_CHUNKS = (
    "archive string, record_no long, record_id long, record_type string, refers_to long, uri string, declared_digest string, "
    "declared_bytes long, chunk_no int, start long, data binary, running_sha1 string, last boolean"
)


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: bytes, refers: int | None, date: str) -> Iterator[bytes]:
    """The parts of a record; the payload is passed on as it is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"))
    head += [] if page is None else [f"X-Page-Id: {page}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers}"]
    head += [f"WARC-Payload-Digest: {_base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode() + http
    yield body
    yield b"\r\n\r\n"


def _writer(base: str, archive_bytes: int, date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, kind, refers = (batch.column(i)[row] for i in range(5))
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                if out is None:
                    # a name of its own for every attempt: only the manifest of attempts that ended well is read
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                for part in _record(kind.as_py(), page.as_py(), url.as_py(), payload, hashlib.sha1(payload).digest(), refers.as_py(), date):
                    for i in range(0, len(part), CHUNK_BYTES):
                        out.write(gz.compress(part[i : i + CHUNK_BYTES]))
                out.write(gz.flush())
                size, n = out.tell(), n + 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, level: int = 6) -> DataFrame:
    """Write one WARC record per row under the folder ``base`` (any URI that pyarrow opens); returns the manifest.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, the one with
    the largest key is the response and the others revisit it; rows that repeat
    that key too are responses as well. Null payloads are empty, null addresses
    empty, a null key is left out of the header and never referred to. Groups of
    equal payloads are found on digests (narrow rows); hot ones are joined by broadcast.
    """
    body = clean_text(payload)
    narrow = materialize(pages.select(F.col(key).cast("long").alias("page"), F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("bytes")), "payloads")
    same = narrow.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page").alias("first"))
    same = materialize(same.where("n > 1 AND first IS NOT NULL"), "repeats")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.cast("binary").alias("payload"), F.unhex(F.sha1(body)).alias("digest"))
    alone = lambda frame: frame.withColumn("first", F.lit(None).cast("long")).select("page", "url", "payload", "first")
    if same.isEmpty():
        rows = alone(rows)
    elif is_small(same):
        rows = rows.join(F.broadcast(same), "digest", "left")
    else:  # payloads that are surely not repeated are written where they are read
        marked = perhaps_in(rows, same, [F.col("digest")], ["digest"], "_hit")
        rows = alone(marked.where("NOT _hit")).unionByName(lookup(marked.where("_hit").drop("_hit"), same, "digest", narrow.count()).select("page", "url", "payload", "first"))
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    plan = rows.select("page", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers"))
    return materialize(plan.mapInArrow(_writer(base, archive_bytes, date, level), _MANIFEST), "manifest")


class _Inflater:
    """Bytes of a file of gzip members, or of a plain file, in pieces; keeps one piece at a time."""

    def __init__(self, stream, piece: int) -> None:
        self.stream, self.piece, self.buffer, self.ended = stream, piece, bytearray(), False
        self.raw, self.gz = b"", None
        self.plain: bool | None = None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.piece)
            if not self.raw:
                if self.gz is not None and not self.gz.eof:
                    raise ValueError("truncated gzip member")
                self.ended = True
                return False
        if self.plain is None:
            self.plain = self.raw[:1] != b"\x1f"
        if self.plain:
            self.buffer += self.raw
            self.raw = b""
            return True
        if self.gz is None or self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.buffer += self.gz.decompress(self.raw, self.piece)
        self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """What stands before ``mark``, which is dropped; empty at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if seen > most:
                raise ValueError("header without an end")
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("truncated header")
                return b""
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def iterate_chunks(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(record_no, headers, declared payload bytes, chunk_no, start, data, running sha1, last) of a WARC stream.

    A record without payload gives one empty chunk. The payload of an HTTP record
    starts after the HTTP header; that of any other record is its whole block.
    """
    source, number = _Inflater(stream, chunk_bytes), 0
    while True:
        head = source.until(b"\r\n\r\n")
        if not head:
            return
        headers = _headers(head.lstrip(b"\r\n"))
        left, declared = int(headers["content-length"]), None
        if headers.get("content-type", "").startswith("application/http") and left:
            http = source.until(b"\r\n\r\n")
            left -= len(http) + 4
            if (length := _headers(http).get("content-length", "")).isdigit():
                declared = int(length)
        sha, chunk, start = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError("truncated record")
            sha.update(data)
            left -= len(data)
            yield number, headers, declared, chunk, start, data, sha.hexdigest(), left == 0
            chunk, start = chunk + 1, start + len(data)
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record without an end mark")
        number += 1


def _hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a ``sha1:BASE32`` header value; null if it is not one."""
    try:
        return base64.b32decode(value.partition(":")[2]).hex() if value else None
    except ValueError:
        return None


def _reader(base: str, chunk_bytes: int):
    names = [f.split()[0] for f in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    number = lambda x: int(x) if x is not None else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(base)
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for no, h, declared, chunk, start, data, sha, last in iterate_chunks(stream, chunk_bytes):
                        rows.append((path, no, number(h.get("x-page-id")), h["warc-type"], number(h.get("x-refers-to-page")), h.get("warc-target-uri"), _hex_digest(h.get("warc-payload-digest")), declared, chunk, start, data, sha, last))
                        held += len(data) + 300
                        if held >= 4 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return read


def read_chunks(manifest: DataFrame, base: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` lists, a task for each few archives.

    ``running_sha1`` covers the payload up to the end of the chunk; on the row
    with ``last`` it is the payload's digest and ``start + length(data)`` its size.
    """
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 100_000))
    dealt = manifest.select("archive").repartitionByRange(tasks, "archive") if tasks > 1 else manifest.select("archive")
    return spark.createDataFrame([], _CHUNKS) if manifest.isEmpty() else dealt.mapInArrow(_reader(base, chunk_bytes), _CHUNKS)


def archive_pages(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, and report each record.

    Columns: page_id, payload_bytes, payload_digest (bare hex SHA-1), record_type,
    refers_to. The digest of a response is that of the bytes read back; it must
    equal the one in the record's header, or the job fails. A revisit has no
    payload: its digest and size are those its headers declare. Null payloads are
    empty, repeated rows are records of their own, an empty table gives no row,
    and columns of other names, also of these, are ignored.
    """
    base = base or scratch_path(pages.sparkSession, "warc")
    ends = read_chunks(write_archives(pages, base), base).where("last")
    full = F.col("record_type") == "response"
    measured = F.when(full, F.col("running_sha1")).otherwise(F.col("declared_digest"))
    sound = ~full | F.col("running_sha1").eqNullSafe(F.col("declared_digest"))
    return ends.select(
        F.col("record_id").alias("page_id"),
        F.when(full, F.col("start") + F.length("data")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(sound, measured).otherwise(F.raise_error(F.concat(F.lit("payload digest differs in record "), F.col("record_id").cast("string")))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
