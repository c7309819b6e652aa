"""Best-fit packing of tokenised documents by a configuration linear program.

The lengths of all pieces make a histogram of at most ``capacity`` bars, whatever
the size of the corpus. A configuration is a multiset of lengths that fits one
sequence; the linear program covers the histogram with as few as it can.

* Multiplicative weights hold a price for each length. They start from the price
  ``length / capacity``, which is dual feasible, and fall as a length is covered.
* A knapsack dynamic program prices: it finds the fullest configurations at those
  prices, several disjoint ones from one table.
* Rounds go on until every length is covered. Rounding takes whole copies of the
  configurations, most used first; what is left is less than one copy of each,
  however large the corpus. Near-full configurations are priced for that again,
  and best fit places the few pieces that then remain.

The plan, a few thousand configurations, goes to all tasks; pieces find their
place from their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, materialize, numbered, release_memory, worker_state

CAPACITY = 2048
#: Encodings of chunks between spaces, and of words, that a worker remembers; emptied when full.
CACHE_CHUNKS = 400_000
#: Characters of text whose new chunks are encoded together.
BATCH_CHARS = 1 << 20
#: Share of a length's demand that a step of the weights may cover, at first; and its growth from round to round, up to
#: all of the demand, when each step closes a length: so the rounds end by themselves, with every length covered.
STEP, STEP_GROWTH = 0.2, 1.02
#: How far weights fall until a length is covered: exp(-TILT).
TILT = 0.5
#: Configurations this close to the best price may be taken in the same round.
SLACK = 0.02

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


def _segments(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """Chunks between single spaces, some of the text at a time."""
    at = 0
    while True:
        end = text.find(" ", at + size)
        yield text[at : end if end >= 0 else len(text)].split(" ")
        if end < 0:
            return
        at = end + 1


#: Fixed value: how this vocabulary's tokenizer cuts lower-case text into words; white space gives none. Null characters, which part chunks here, stand alone.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\0]+|\0")
#: What the library must see as it is: characters beyond Latin-1, null characters, and the start of a special token.
_OTHER = regex.compile(r"[^\x01-\xff]|<\|")
#: Between the ids of chunks; no id has its upper bytes set.
_MARK = b"\xff" * 4


class ChunkEncoder:
    """Ids of whole texts as bytes, from a tokenizer file of words without white space.

    No token spans a space, so a text is encoded chunk by chunk, each distinct
    chunk once. A chunk of Latin-1 characters, whose normal form is its lower
    case, is looked up word by word; the library encodes new words, all other
    chunks, and those in which a special token may stand.
    """

    def __init__(self, path: str, most: int) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, in texts of many words: the last token of each word, and no other, is one that ends a word."""
        texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]) if texts else np.zeros(0, "<u4")
        cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks, as many at once as there are."""
        for cache in (self.chunks, self.words):
            if len(cache) > self.most:
                cache.clear()
        new = list(chunks.difference(self.chunks))
        if _OTHER.search(" ".join(new)):
            other = [c for c in new if _OTHER.search(c)]
            self.chunks.update(zip(other, self._library(other), strict=True))
            new = list(set(new).difference(other))
        words = _WORDS.findall("\0".join(new).lower())
        unknown = list(set(words).difference(self.words, "\0"))
        self.words.update(zip(unknown, self._library_words(unknown), strict=True))
        self.words["\0"] = _MARK
        self.chunks.update(zip(new, b"".join(map(self.words.__getitem__, words)).split(_MARK), strict=True) if new else ())

    def _joined(self, chunks: list[str]) -> bytes:
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            self.learn(set(chunks))
            return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self._joined, _segments(text)))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text in order; what is new in about ``BATCH_CHARS`` characters is learned at once."""
        held: list[str | list[str]] = []
        size = 0
        for value in [*texts, None]:
            if value is not None:
                text = value.as_py() or ""
                held.append(text if len(text) > BATCH_CHARS else text.split(" "))
                size += len(text)
            if value is None or size >= BATCH_CHARS:
                self.learn(set().union(*(t for t in held if isinstance(t, list))))
                for t in held:
                    yield self._joined(t) if isinstance(t, list) else self.encode(t)
                held, size = [], 0


def _encoder(path: str, most: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One for each worker process, which keeps what it has learned from task to task."""
    return worker_state(("chunks", path, most), lambda: ChunkEncoder(path, most))


def _piece_rows(tokenizer_path: str, capacity: int, end_id: int, remembered: int):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, remembered)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids = memoryview(body + end)
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for col, value in zip(cols, (doc, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release_memory(keep=("chunks", tokenizer_path, remembered))

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", remembered: int = CACHE_CHUNKS) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``capacity`` ids, the last one as long as it is; null texts are empty."""
    return docs.select(F.col(key).cast("long"), clean_text(text).alias("text")).mapInArrow(_piece_rows(tokenizer_path, capacity, end_id, remembered), _PIECES)


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """``configs``: (lengths and multiplicities, copies). ``lower_bound``: no packing needs fewer sequences.

    ``priced``: different configurations of the linear program; ``fitted``: pieces that were left to best fit.
    """

    configs: list[tuple[tuple[tuple[int, int], ...], int]]
    lower_bound: int
    priced: int
    fitted: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the length taken first there (0: none)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = upto[room]
        if k:
            worth = values[:k] + best[room - lengths[:k]]
            i = int(worth.argmax())
            if worth[i] > best[room - 1]:
                best[room], first[room] = worth[i], lengths[i]
                continue
        best[room], first[room] = best[room - 1], -1
    return best, first


def _config(start: int, first: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration that holds ``start`` and is best in the room it leaves."""
    got, room = {start: 1}, capacity - start
    while room > 0 and first[room]:
        if first[room] < 0:
            room -= 1
            continue
        length = int(first[room])
        got[length] = got.get(length, 0) + 1
        room -= length
    return got


def _disjoint(order: np.ndarray, values: dict[int, float], best: np.ndarray, first: np.ndarray, capacity: int, left: np.ndarray, slack: float) -> Iterator[dict[int, int]]:
    """Near-best configurations that share no length and need no more of one than is left."""
    used: set[int] = set()
    for start in order.tolist():
        if start in used or values[start] + best[capacity - start] < (1 - slack) * best[capacity]:
            continue
        config = _config(start, first, capacity)
        if not used.isdisjoint(config) or any(left[length] < n for length, n in config.items()):
            continue
        used.update(config)
        yield config


def _cover(demand: np.ndarray, capacity: int, seed: int) -> tuple[dict[tuple, float], float]:
    """Fractional cover of the whole demand by multiplicative weights: configurations with their use, and the best dual bound seen."""
    lengths_all = np.flatnonzero(demand)
    rng = np.random.default_rng(seed)
    covered = np.zeros(capacity + 1)
    use: dict[tuple, float] = {}
    bound = 0.0
    step = STEP
    while len(open_ := lengths_all[covered[lengths_all] < 1 - 1e-9]):
        weight = open_ / capacity * np.exp(-TILT * covered[open_]) * (1 + 1e-3 * rng.random(len(open_)))
        best, first = _knapsack(weight, open_, capacity)
        if len(open_) == len(lengths_all):
            bound = max(bound, float((demand[open_] * weight).sum() / best[capacity]))
        values = dict(zip(open_.tolist(), weight.tolist(), strict=True))
        # the least covered first; of these the longest, which are the hardest to place
        order = open_[np.lexsort((-open_, np.round(covered[open_], 3)))]
        for config in _disjoint(order, values, best, first, capacity, np.full(capacity + 1, capacity), SLACK):
            # a step covers a share of the scarcest length, and no length beyond its demand
            copies = min(min(step, 1 - covered[x]) * demand[x] / n for x, n in config.items())
            for x, n in config.items():
                covered[x] += copies * n / demand[x]
            key = tuple(sorted(config.items()))
            use[key] = use.get(key, 0.0) + copies
        step = min(1.0, step * STEP_GROWTH)
    return use, bound


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Best fit, longest first, of the pieces that rounding left."""
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[dict[int, int]] = []
    for length in np.flatnonzero(left)[::-1].tolist():
        for _ in range(int(left[length])):
            i = bisect.bisect_left(rooms, (length, -1))
            if i < len(rooms):
                room, b = rooms.pop(i)
            else:
                room, b = capacity, len(bins)
                bins.append({})
            bins[b][length] = bins[b].get(length, 0) + 1
            if room > length:
                bisect.insort(rooms, (room - length, b))
    return [tuple(sorted(b.items())) for b in bins]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, seed: int = 7) -> Plan:
    """Configurations that hold exactly the pieces of ``histogram`` (length: number)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    area = -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
    use, dual = _cover(left.astype(float), capacity, seed)
    taken: dict[tuple, int] = {}

    def take(config: tuple, most: int) -> None:
        copies = min([most, *(int(left[x]) // n for x, n in config)])
        if copies > 0:
            taken[config] = taken.get(config, 0) + copies
            for x, n in config:
                left[x] -= n * copies

    ordered = sorted(use.items(), key=lambda x: (-x[1], x[0]))
    for config, x in ordered:
        take(config, int(x))
    # a second pass rounds up, a full configuration at a time, before best fit takes the rest
    for config, x in sorted(use.items(), key=lambda c: (-sum(a * b for a, b in c[0]), -(c[1] - int(c[1])), c[0])):
        if x > int(x) and sum(a * b for a, b in config) == capacity:
            take(config, 1)
    moved = True
    while moved and left.sum() >= 64:
        open_ = np.flatnonzero(left)
        weight = open_ / capacity * (1 + 0.05 * open_ / capacity)
        best, first = _knapsack(weight, open_, capacity)
        values = dict(zip(open_.tolist(), weight.tolist(), strict=True))
        moved = False
        for config in list(_disjoint(open_[::-1], values, best, first, capacity, left, 0.05)):
            if sum(a * b for a, b in config.items()) >= capacity - 1:
                take(tuple(sorted(config.items())), max(1, min(int(left[x]) // n for x, n in config.items()) // 2))
                moved = True
    fitted = int(left.sum())
    for config in _best_fit(left, capacity):
        taken[config] = taken.get(config, 0) + 1
    return Plan(sorted(taken.items()), max(area, int(np.ceil(dual - 1e-6))), len(use), fitted)


def _runs(plan: Plan, capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: (length, first rank, copies, first sequence, offset), sorted by length and rank."""
    rows, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for config, copies in plan.configs:
        offset = 0
        for length, n in config:
            for _ in range(n):
                rows.append((length, rank[length], copies, sequence, offset))
                rank[length] += copies
                offset += length
        sequence += copies
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _place(runs: dict[str, np.ndarray]):
    where = runs["length"] * (1 << 48) + runs["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            i = np.searchsorted(where, length * (1 << 48) + rank, "right") - 1
            sequence = runs["sequence"][i] + rank - runs["rank"][i]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(runs["offset"][i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", remembered: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has a piece, as the end id follows an empty or null text too.
    Equal texts and repeated rows give pieces of their own. An empty table gives
    no row; columns of other names, also of these, are ignored. The driver sees
    the histogram of lengths only, at most ``capacity`` numbers.
    A worker remembers the ids of about ``remembered`` chunks and as many words,
    which trades its memory for its time and changes no result.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, key, text, remembered).withColumn("_row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = _runs(plan_packing(histogram, capacity), capacity)
    ranked = numbered(pieces, "length", ["doc_id", "piece", "_row"], sum(histogram.values()), "rank")
    placed = ranked.mapInArrow(_place(runs), _PIECES + ", sequence_id long, offset long")
    return placed if key == "doc_id" else placed.withColumnRenamed("doc_id", key)
