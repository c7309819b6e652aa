"""Byte-level BPE by speculation: propose, verify, and merge only what fails.

A word's tokens are proposed by greedy longest match over the vocabulary, all
words of a batch in one automaton pass. A sequence of tokens is the encoding of
its bytes exactly when each token encodes itself and each adjacent pair encodes
to itself, so one table of pairs, filled as pairs appear and looked up for a
whole batch at once, verifies the proposals. Words with a failing pair are merged
by rank. Decoding joins the bytes of the tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, worker_state

#: Fixed value: the pre-tokenisation pattern of this family of vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for units with null characters between them, which stand alone; white space before one is at its unit's end.
_PARTED = regex.compile(r"\0|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\0]+|\s+(?![^\s\0])|\s+")
#: Between the ids of units; no id is as large.
_MARK = b"\xff" * 4
_SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
#: Units (text between single spaces), and words, whose ids a worker remembers; emptied when full.
CACHE_UNITS = 700_000
CACHE_WORDS = 700_000
#: Up to this many bytes a word is merged by scanning its pairs, beyond by a queue.
SHORT = 48
#: Characters of text whose new words are proposed and verified together.
BATCH_CHARS = 1 << 20
SEGMENT_CHARS = 1 << 20
_ALONE = (1 << 31) - 1


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable in Latin-1, else the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class SpeculativeBPE:
    """A byte-level vocabulary read from a ``tokenizer.json``; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_characters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.byte_ids = [vocab[c] for _, c in sorted(byte_characters().items())]
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(raw(token).decode("latin-1"), i)
        self.automaton.make_automaton()
        self._pairs, self._sound = np.zeros(0, np.int64), np.zeros(0, bool)
        self._spaced: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._packed = {a << 20 | b: rank << 20 | made for (a, b), (rank, made) in self.ranks.items()}
        self.failed = self.verified = 0

    # ------------------------------------------------------------ words

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: the adjacent pair of least rank merges first, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            return self._scan(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*self.ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            _, made, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := self.ranks.get((ids[a], ids[b]))):
                    heapq.heappush(queue, (*found, a, (ids[a], ids[b])))
        return [i for i in ids if i >= 0]

    def _scan(self, ids: list[int]) -> list[int]:
        """``merge`` for short words: the pair of least rank is looked for among all that are left."""
        find, none = self._packed.get, 1 << 60
        pairs = [find(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            ids[i : i + 2] = [least & 0xFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = find(ids[i - 1] << 20 | ids[i], none)
            if i < len(pairs):
                pairs[i] = find(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (first << 31 | second; second ``_ALONE`` for a token by itself) encodes to itself."""
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self._pairs, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self._pairs)
        known[inside] = self._pairs[at[inside]] == distinct[inside]
        if not known.all():
            new = distinct[~known]
            sound = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                ids = [key >> 31, key & _ALONE]
                ids = ids[:1] if ids[1] == _ALONE else ids
                sound[k] = self.merge(b"".join(self.bytes_of[i] for i in ids)) == ids
            pairs, sound = np.r_[self._pairs, new], np.r_[self._sound, sound]
            order = np.argsort(pairs)
            self._pairs, self._sound = pairs[order], sound[order]
            at = np.searchsorted(self._pairs, distinct)
        return self._sound[at][back]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, 32 bits each: proposed and verified together, merged exactly where verification fails."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        joined = "Ā".join(w.decode("latin-1") for w in words)  # no token has that character
        hits = np.array(list(self.automaton.iter_long(joined)), np.int64).reshape(-1, 2)
        ids, word = hits[:, 1], np.searchsorted(ends, hits[:, 0], "right")
        same = word[1:] == word[:-1]
        sound = self._compatible(np.r_[(ids[:-1][same] << 31) | ids[1:][same], (ids << 31) | _ALONE])
        bad = np.unique(np.r_[word[1:][same], word][~sound])
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in bad.tolist():
            out[i] = array("I", self.merge(words[i])).tobytes()
        self.failed += len(bad)
        self.verified += len(words)
        return out

    # ------------------------------------------------------------ texts

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of texts that stand between sure boundaries; each distinct word is encoded once."""
        known = self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        joined = "\0".join(units)
        if joined.count("\0") >= len(units):  # some text has null characters itself
            pieces = [PATTERN.findall(u) for u in units]
            words = list(chain.from_iterable(pieces))
        else:
            pieces, words = None, _PARTED.findall(joined)
        known["\0"] = _MARK
        new = list(set(words).difference(known))
        known.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        if pieces is not None:
            known["\0"] = self.encode_words([b"\0"])[0]
            return [b"".join(map(known.__getitem__, p)) for p in pieces]
        return b"".join(map(known.__getitem__, words)).split(_MARK) if units else []

    @staticmethod
    def _parts(text: str) -> list[str]:
        """No word spans a single space between two other characters but begins with it, so such spaces part the text."""
        return text.split(" ") if "  " not in text else _SINGLE_SPACE.split(text)

    def _remember(self, units: set[str]) -> None:
        if len(self._spaced) > CACHE_UNITS:
            self._spaced.clear()
        new = list(units.difference(self._spaced))
        self._spaced.update(zip(new, self._units([" " + u for u in new]), strict=True))

    def learn(self, texts: list[str]) -> None:
        """Propose and verify the new words of several texts together, before they are encoded one by one."""
        parts = [self._parts(t) for t in texts]
        self._units([p[0] for p in parts])
        self._remember(set().union(*parts))

    def _plain(self, text: str, opening: bool) -> list[int]:
        """A text without special tokens."""
        parts = self._parts(text)
        first = self._units(parts[:1]) if opening else []
        rest = parts[1:] if opening else parts
        try:
            ids = b"".join([*first, *map(self._spaced.__getitem__, rest)])
        except KeyError:
            self._remember(set(rest))
            ids = b"".join([*first, *map(self._spaced.__getitem__, rest)])
        return np.frombuffer(ids, "<u4").tolist()

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some at a time. Strings of special tokens give their ids, as by default in the library."""
        segments = [(text, None)]
        for content, i in self.special.items():
            segments = [x for s, kind in segments for x in ([(s, kind)] if kind is not None else self._around(s, content, i))]
        for segment, special in segments:
            if special is not None:
                yield [special]
                continue
            at = 0
            while at < len(segment) or not at:
                end, opening = at + SEGMENT_CHARS, not at
                found = _SINGLE_SPACE.search(segment, end - 1) if end < len(segment) else None
                end = found.start() if found else len(segment)
                if segment:
                    yield self._plain(segment[at:end], opening)
                at = end + 1

    @staticmethod
    def _around(text: str, content: str, i: int) -> list[tuple[str, int | None]]:
        parts = text.split(content)
        return [x for k, p in enumerate(parts) for x in ([(content, i)] if k else []) + [(p, None)]]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_parts(text) for i in part]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _vocabulary(path: str) -> SpeculativeBPE:
    """One for each worker process, which keeps the words and pairs it has seen from task to task."""
    return worker_state(("bpe", path), lambda: SpeculativeBPE(path))


def _fixed(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _groups(texts: pa.Array, bpe: SpeculativeBPE) -> Iterator[str]:
    """The texts in order; the words of about ``BATCH_CHARS`` characters of them are learned at once."""
    held, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            bpe.learn([t for t in held if len(t) <= SEGMENT_CHARS])
            yield from held
            held, size = [], 0
    bpe.learn([t for t in held if len(t) <= SEGMENT_CHARS])
    yield from held


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text; null counts as empty, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(path)
        for batch in batches:
            yield _fixed([("k", pa.int64()), ("ids", pa.list_(pa.int32()))], [(k, bpe.encode(t)) for k, t in zip(batch.column(0).to_pylist(), _groups(batch.column(1), bpe), strict=True)])

    return docs.select(F.col(key).cast("long"), clean_text(text)).mapInArrow(run, "k long, ids array<int>").withColumnRenamed("k", key)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each list of ids; a null list decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(path)
        for batch in batches:
            yield _fixed([("k", pa.int64()), ("text", pa.string())], [(k, bpe.decode(i or [])) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return encoded.select(F.col(key).cast("long"), F.col(ids)).mapInArrow(run, "k long, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the text decoded from them.

    Encoding and decoding go through a text in parts, so a very long one is never
    held as a whole list of ids. Null counts as empty; repeated rows give equal
    values; nothing is shuffled.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(path)
        decimal = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            rows = []
            for doc, whole in zip(batch.column(0).to_pylist(), _groups(batch.column(1), bpe), strict=True):
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode_parts(whole):
                    if not ids:
                        continue
                    of_ids.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                    # parts end between words, so their bytes are whole characters
                    of_text.update(bpe.decode_bytes(ids).decode("utf-8", "replace").encode())
                    n += len(ids)
                rows.append((doc, n, of_ids.hexdigest(), of_text.hexdigest()))
            yield _fixed(fields, rows)

    out = docs.select(F.col(key).cast("long"), clean_text(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
