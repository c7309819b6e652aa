"""Hard negatives by a Voronoi-partitioned nearest-neighbour join, exact.

One more coordinate gives every vector the same norm, so that a larger inner
product with an anchor is a smaller distance. Every vector belongs to the cell of
its nearest pivot. An anchor first meets a bounded block of its own cell, which
bounds the scores it still has to look for; that bound and the cells' radii tell
which distances from a pivot its group can need, and candidates are sent only to
groups whose ring they lie in. There, blocks of candidates meet blocks of anchors
in products of matrices, and the best of each block are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import Scratch, broadcast_if_small

#: Pivots are so many rows of least hash: a bounded sample that decides about speed alone.
PIVOTS = 64
#: Most anchors of a group and most candidates of a block: what one task holds.
GROUP, BLOCK = 4096, 32_768
#: Cells of a matrix of scores that are held at once.
TILE = 1 << 21
#: Products below this are exact in doubles; beyond the second, a score does not fit a long.
EXACT, LARGEST = 2.0**53, 2.0**62

_ROWS = "row long, id long, label string, anchor boolean, cell int, home int, r double, vec binary"


# ---------------------------------------------------------------- vectors


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector (-1: null), whether all its components are finite, and floor(scale * x) of all components in a row."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    ends = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    finite = (lengths >= 0) & (bad[ends[1:]] == bad[ends[:-1]])
    return lengths, finite, np.floor(scale * flat)


def _matrix(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of some rows, all of ``dim`` components, line by line."""
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    return flat[starts[rows][:, None] + np.arange(dim)[None, :]]


SHAPE = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("norm2", pa.float64()), ("top", pa.float64())])


def _shapes(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, finite, flat = _vectors(batch.column(0), scale)
            found = []
            for dim in np.unique(lengths[finite]).tolist():
                block = _matrix(flat, lengths, np.flatnonzero(finite & (lengths == dim)), dim)
                found.append((dim, len(block), float((block**2).sum(1).max()), float(np.abs(block).max(initial=0.0))))
            yield pa.RecordBatch.from_pylist([dict(zip(SHAPE.names, f, strict=True)) for f in found], SHAPE)

    return run


@dataclass(frozen=True)
class Space:
    """What all tasks know: number of components, largest squared norm, how vectors are stored, and the pivots with their coordinate more."""

    dim: int
    norm2: float
    kind: str
    pivots: np.ndarray
    scale: float

    @property
    def lifted(self) -> np.ndarray:
        """The coordinate that gives each pivot the largest norm."""
        return np.sqrt(np.maximum(self.norm2 - (self.pivots**2).sum(1), 0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance by."""
        return 1e-6 * (1 + np.sqrt(self.norm2))

    def read(self, column: pa.Array) -> np.ndarray:
        """A matrix of doubles from stored vectors."""
        stored = b"".join(column.to_pylist())
        return np.frombuffer(stored, self.kind).astype(np.float64).reshape(len(column), self.dim) if stored else np.zeros((len(column), self.dim))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        if self.norm2 < EXACT:
            return np.rint(a @ b.T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T

    def between_pivots(self) -> np.ndarray:
        whole = np.hstack([self.pivots, self.lifted[:, None]])
        return np.sqrt(np.maximum(((whole[:, None, :] - whole[None, :, :]) ** 2).sum(2), 0))


def _dealt(space: Space):
    """Rows that take part, with the nearest pivot of the vector as a candidate and as an anchor, and the distance from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, finite, flat = _vectors(batch.column(3), space.scale)
            rows = np.flatnonzero(finite & (lengths == space.dim))
            x = _matrix(flat, lengths, rows, space.dim)
            inner = x @ space.pivots.T
            lift = np.sqrt(np.maximum(space.norm2 - (x**2).sum(1), 0))
            far = np.sqrt(np.maximum(2 * space.norm2 - 2 * (inner + lift[:, None] * space.lifted[None, :]), 0))
            cell = far.argmin(1)
            stored = x.astype(space.kind)
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*own.columns[:3], own.column(4), pa.array(cell, pa.int32()), pa.array(inner.argmax(1), pa.int32()), pa.array(far[np.arange(len(x)), cell], pa.float64()), pa.array([v.tobytes() for v in stored], pa.binary())],
                names=["row", "id", "label", "anchor", "cell", "home", "r", "vec"],
            )

    return run


# ---------------------------------------------------------------- blocks of candidates against blocks of anchors


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` largest allowed scores of each line (all, if fewer), in no order; of equal scores the earlier columns."""
    n, width = scores.shape
    if not n or not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowest = np.iinfo(np.int64).min
    if width <= k:
        at = np.broadcast_to(np.arange(width), (n, width))
    elif (float(np.abs(scores).max()) + 1) * width < LARGEST:
        at = np.argpartition(np.where(allowed, scores * width - np.arange(width), lowest), width - k, axis=1)[:, width - k :]
    else:
        at = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    line, column = np.repeat(np.arange(n), at.shape[1]), at.ravel()
    keep = allowed[line, column]
    return line[keep], column[keep]


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def _meeting(space: Space, left: pa.Table, right: pa.Table):
    """The tiles of an anchors' and a candidates' table: anchors' places, scores, whether labels agree, whether rows differ. Candidates stand in order."""
    labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], pa.string()).combine_chunks()
    codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    a, b = space.read(left.column("vec").combine_chunks()), space.read(right.column("vec").combine_chunks())
    rows = left.column("row").to_numpy(), right.column("row").to_numpy()
    step = max(1, TILE // max(1, len(b)))
    for i in range(0, len(a), step):
        part = slice(i, min(i + step, len(a)))
        same = codes[: len(a)][part, None] == codes[None, len(a) :]
        yield np.arange(part.start, part.stop), space.products(a[part], b), same, rows[0][part, None] != rows[1][None, :]


def _least(line: np.ndarray, scores: np.ndarray, n: int, k: int, other: np.ndarray) -> np.ndarray:
    """The least of ``k`` scores found for each line, ``other`` where fewer were found."""
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, line, scores)
    return np.where(np.bincount(line, minlength=n) >= k, out, other)


NONE = -(1 << 62)


def _positive_floor(space: Space, k: int):
    """The anchors with a score that ``k`` rows of their label are known to reach."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        floor = np.full(len(left), NONE)
        for at, scores, same, other in _meeting(space, left, _in_order(right)):
            line, column = best(scores, same & other, k)
            floor[at] = _least(line, scores[line, column], len(at), k, floor[at])
        return left.append_column("floor", pa.array(floor, pa.int64()))

    return run


def _positives(space: Space, k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = _in_order(right)
        floor, out = left.column("floor").to_numpy(), []
        for at, scores, same, other in _meeting(space, left, right):
            line, column = best(scores, same & other & (scores >= floor[at, None]), k)
            out.append((at[line], column, scores[line, column]))
        a, c, s = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3))
        return pa.table({"anchor": left.column("row").take(pa.array(a)), "row": right.column("row").take(pa.array(c)), "id": right.column("id").take(pa.array(c)), "score": pa.array(s, pa.int64())})

    return run


def _bands(left: pa.Table, name: str, width: int) -> np.ndarray:
    """An array column of at most ``width`` longs as a matrix."""
    out = np.full((len(left), width), 0, np.int64)
    for i, values in enumerate(left.column(name).to_pylist()):
        out[i, : len(values)] = values
    return out


def _negative_floor(space: Space, k: int, positives: int):
    """The anchors with, for each positive, a score that ``k`` rows of its band are known to reach; at least the band's low end."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        counts = pc.list_value_length(left.column("low")).to_numpy()
        low, high = _bands(left, "low", positives), _bands(left, "high", positives)
        floor = low.copy()
        for at, scores, same, _ in _meeting(space, left, _in_order(right)):
            for j in range(positives):
                lo, hi = low[at, j, None], high[at, j, None]
                line, column = best(scores, ~same & (scores >= lo) & (scores <= hi) & (counts[at] > j)[:, None], k)
                floor[at, j] = _least(line, scores[line, column], len(at), k, low[at, j])
        floors = [floor[i, : counts[i]].tolist() for i in range(len(left))]
        return left.append_column("floors", pa.array(floors, pa.list_(pa.int64())))

    return run


def _negatives(space: Space, k: int, positives: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = _in_order(right)
        counts = pc.list_value_length(left.column("high")).to_numpy()
        floor, high, out = _bands(left, "floors", positives), _bands(left, "high", positives), []
        for at, scores, same, _ in _meeting(space, left, right):
            for j in range(positives):
                line, column = best(scores, ~same & (scores >= floor[at, j, None]) & (scores <= high[at, j, None]) & (counts[at] > j)[:, None], k)
                out.append((at[line], np.full(len(line), j), column, scores[line, column]))
        a, j, c, s = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(4))
        return pa.table({"anchor": left.column("row").take(pa.array(a)), "place": pa.array(j, pa.int32()), "row": right.column("row").take(pa.array(c)), "id": right.column("id").take(pa.array(c)), "score": pa.array(s, pa.int64())})

    return run


# ---------------------------------------------------------------- cells, groups, rings


@dataclass(frozen=True)
class Cells:
    """Of each cell, at most ``PIVOTS``: rows and range of distances; blocks of candidates; first and number of the groups of its anchors."""

    least: np.ndarray
    most: np.ndarray
    blocks: list[int]
    first: list[int]
    groups: list[int]


def _chain(between: np.ndarray) -> list[int]:
    """The pivots, each followed by the nearest one that is left."""
    order, left = [0], set(range(1, len(between)))
    while left:
        order.append(min(left, key=lambda c: (between[order[-1], c], c)))
        left.discard(order[-1])
    return order


def plan_cells(space: Space, stats: list[tuple[int, int, float, float]], homes: dict[int, int]) -> Cells:
    """Blocks even out the cells; groups take neighbouring cells together until they are full, and a cell with more anchors is split."""
    n = len(space.pivots)
    counts, least, most = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
    for cell, rows, r0, r1 in stats:
        counts[cell], least[cell], most[cell] = rows, r0, r1
    size = int(min(BLOCK, max(256, 2 * counts.sum() // n)))
    first, groups, used, filled = [0] * n, [1] * n, -1, GROUP
    for cell in _chain(space.between_pivots()):
        anchors = homes.get(cell, 0)
        if filled + anchors > GROUP:
            used, filled = used + 1, 0
        first[cell], groups[cell] = used, max(1, -(-anchors // GROUP))
        filled += anchors
        used += groups[cell] - 1
    return Cells(least, most, [max(1, -(-int(c) // size)) for c in counts], first, groups)


def _rings(space: Space, cells: Cells, low: str, high: str | None):
    """Of each group and cell that it can need: the range of distances from the cell's pivot, over the anchors of a batch."""
    between = space.between_pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = space.read(batch.column(0))
            if not len(q):
                continue
            home, group = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ends = lambda i, f: np.array([f(v) if isinstance(v, list) else v for v in batch.column(i).to_pylist()], np.float64)
            square = (q**2).sum(1) + space.norm2
            floor = ends(3, min)
            far = np.where(floor <= NONE, np.inf, np.sqrt(np.maximum(square - 2 * floor, 0))) + space.slack
            near = np.sqrt(np.maximum(square - 2 * ends(4, max), 0)) - space.slack if high else np.zeros(len(q))
            own = np.sqrt(np.maximum(square[:, None] - 2 * q @ space.pivots.T, 0))
            apart = between[home]
            plane = np.where(apart > 0, (own**2 - own[np.arange(len(q)), home][:, None] ** 2) / (2 * np.where(apart > 0, apart, 1)), 0)
            least = np.maximum(np.maximum(own - cells.most, cells.least - own), plane)
            reach = np.isfinite(cells.least) & (least - space.slack <= far[:, None]) & (own + cells.most + space.slack >= near[:, None])
            lo = np.where(reach, np.maximum(own - far[:, None], near[:, None] - own) - space.slack, np.inf)
            hi = np.where(reach, own + far[:, None] + space.slack, -np.inf)
            for g in np.unique(group):
                some = group == g
                l, h = lo[some].min(0), hi[some].max(0)
                at = np.flatnonzero(reach[some].any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g), pa.int32()), pa.array(at, pa.int32()), pa.array(l[at], pa.float64()), pa.array(h[at], pa.float64())], names=["grp", "cell", "lo", "hi"])

    return run


def _choose(values: list[int], index: Column) -> Column:
    """The element of a short list of numbers, one for each cell."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def _met(anchors: DataFrame, candidates: DataFrame, kernel, schema: str) -> DataFrame:
    """Each (group, cell, block) in a task of its own: at most ``GROUP`` anchors and about ``BLOCK`` candidates."""
    keys = ["grp", "at", "block"]
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # both sides may stem from one table
    return anchors.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(kernel, schema)


class _Join:
    """The stored rows, their cells and what a pass over them needs."""

    def __init__(self, space: Space, cells: Cells, rows: DataFrame, scratch: Scratch) -> None:
        self.space, self.cells, self.scratch = space, cells, scratch
        self.candidates = rows.select("row", "id", "label", "cell", "r", "vec", F.pmod(F.xxhash64("row"), _choose(cells.blocks, F.col("cell"))).cast("int").alias("block"))

    def scout(self, anchors: DataFrame, kernel, more: str, name: str) -> DataFrame:
        """The anchors, each after it has met one block of the cell it lies in."""
        homes = anchors.select("grp", "cell").distinct()
        near = self.candidates.where("block = 0").join(broadcast_if_small(homes), "cell").withColumn("at", F.col("cell"))
        own = anchors.withColumns({"at": F.col("cell"), "block": F.lit(0)})
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + f", {more}"
        return self.scratch.store(_met(own, near, kernel, schema).drop("at", "block"), name)

    def serve(self, anchors: DataFrame, kernel, schema: str, floor: str, high: str | None = None) -> DataFrame:
        """What anchors find among all candidates that lie in a ring of their group."""
        rings = anchors.select("vec", "cell", "grp", floor, *([high] if high else [])).mapInArrow(_rings(self.space, self.cells, floor, high), "grp int, cell int, lo double, hi double")
        rings = self.scratch.store(rings.groupBy("grp", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"rings-{floor}")
        rings = rings.withColumnRenamed("cell", "at")
        sent = self.candidates.withColumn("at", F.col("cell")).join(broadcast_if_small(rings), "at").where(F.col("r").between(F.col("lo"), F.col("hi")))
        blocks = rings.withColumn("block", F.explode(F.sequence(F.lit(0), _choose(self.cells.blocks, F.col("at")) - 1))).select("grp", "at", "block")
        asked = anchors.join(blocks, "grp")
        return _met(asked, sent.select("grp", "at", "block", "row", "id", "label", "vec"), kernel, schema)


def _first(rows: DataFrame, group: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group by score, then key; what is not among the first of a part goes before the shuffle."""
    order = W.Window.partitionBy(*group).orderBy(F.desc("score"), "id", "row")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    pivots: int = PIVOTS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """For each anchor and each of its first ``positives``, the first ``negatives`` rows of other labels in the score band.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Components count as floor(scale * x). A negative's score lies
    between ``band`` hundredths of the positive's. Rows whose key, label or vector
    is null, whose vector has a component that is null or not finite, or another
    length than most (of lengths equally frequent the larger), take no part.
    ``anchors`` is a condition on the table's columns; null is no anchor. Ties go
    to the smaller key. Repeated rows, also of one key, are rows of their own: each
    may be the other's positive, and repeated anchors give repeated results. An
    empty table, or one without anchors, gives none. Scores that might not fit a
    long are an ArithmeticError. Other columns, also of these names, are ignored.

    Nothing is collected but one row for each pivot. Without structure in the data
    no ring excludes anything: then every candidate goes to every group of
    ``GROUP`` anchors. Tables stay in ``scratch``, for the caller to close, until the result is read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = whole.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    shapes = whole.select("vec").mapInArrow(_shapes(scale), "dim int, n long, norm2 double, top double")
    shape = shapes.groupBy("dim").agg(F.sum("n").alias("n"), F.max("norm2").alias("norm2"), F.max("top").alias("top")).orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None:
        return spark.createDataFrame([], out)
    if not shape["norm2"] < LARGEST:
        raise ArithmeticError("scores of these vectors might not fit a long")
    kind = "<i2" if shape["top"] < 2**15 else "<i4" if shape["top"] < 2**31 else "<i8"
    space = Space(shape["dim"], shape["norm2"], kind, np.zeros((1, shape["dim"])), scale)

    drawn = whole.select("row", "id", "label", "vec", "anchor").mapInArrow(_dealt(space), _ROWS)
    drawn = drawn.orderBy(F.xxhash64("id"), "id", "row").limit(pivots).select("vec").toArrow()
    space = Space(space.dim, space.norm2, kind, np.unique(space.read(drawn.column(0).combine_chunks()), axis=0), scale)

    rows = scratch.store(whole.select("row", "id", "label", "vec", "anchor").mapInArrow(_dealt(space), _ROWS), "rows")
    stats = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r"), F.max("r")).collect()
    homes = {r["home"]: r["n"] for r in rows.where("anchor").groupBy("home").agg(F.count("*").alias("n")).collect()}
    if not homes:
        return spark.createDataFrame([], out)
    cells = plan_cells(space, [tuple(r) for r in stats], homes)
    join = _Join(space, cells, rows, scratch)

    group = _choose(cells.first, F.col("home")) + F.pmod(F.xxhash64("row"), _choose(cells.groups, F.col("home"))).cast("int")
    asked = rows.where("anchor").select("row", "id", "label", F.col("home").alias("cell"), group.cast("int").alias("grp"), "vec")
    asked = join.scout(asked, _positive_floor(space, positives), "floor long", "anchors")
    found = join.serve(asked, _positives(space, positives), "anchor long, row long, id long, score long", "floor")
    found = scratch.store(_first(found, ["anchor"], positives, "place"), "positives")

    hundredths = "{0} * ((score - pmod(score, 100)) div 100) + ({0} * pmod(score, 100) - pmod({0} * pmod(score, 100), 100)) div 100"  # rounded down; no step leaves a long
    bands = found.withColumns({"low": -F.expr(hundredths.format(f"({-band[0]})")), "high": F.expr(hundredths.format(f"({band[1]})"))}).where("low <= high")
    bands = bands.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "low", "high"))).alias("p"))
    wanted = asked.drop("floor").join(bands, "row").select(*asked.drop("floor").columns, F.col("p.id").alias("positive"), F.col("p.score").alias("reached"), F.col("p.low").alias("low"), F.col("p.high").alias("high"))
    wanted = join.scout(wanted, _negative_floor(space, negatives, positives), "floors array<bigint>", "wanted")
    mined = join.serve(wanted, _negatives(space, negatives, positives), "anchor long, place int, row long, id long, score long", "floors", "high")
    mined = _first(mined, ["anchor", "place"], negatives, "rank")
    told = wanted.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "positive", "reached")
    at = F.col("place") + 1
    return mined.join(told, "anchor").select("anchor_id", F.element_at("positive", at).alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.element_at("reached", at).alias("positive_score"), F.col("score").alias("negative_score"))
