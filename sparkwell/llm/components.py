"""Connected components of a stored edge list, by contraction in parts and stars between them; nothing is gathered at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hot_threshold, lookup

#: Edges that a task gets, about.
TASK_EDGES = 250_000
#: Edges that are contracted at once; what they leave, at most one edge a node, is contracted with the next ones.
PART_EDGES = 1_000_000

_EDGES = "node long, root long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of edges (a, b) that are not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # the larger root hooks to the smaller one; then every node points to the end of its chain
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[low], root[high]
        open_ = x != y
        x, y = x[open_], y[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= PART_EDGES:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0
    if held:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _contract(edges: DataFrame, most: int) -> DataFrame:
    """Stars of the parts of up to ``most`` edges; the fewer the parts, the less is left to the rounds."""
    return edges.coalesce(max(1, -(-most // TASK_EDGES))).mapInArrow(_contracted, _EDGES)


def _hub_lookup(scratch: Scratch, rows: DataFrame, key: str, values: DataFrame, total: int) -> DataFrame:
    """``rows LEFT JOIN values USING (key)``, where many rows may name one key."""
    busy = rows.groupBy(key).agg(F.count("*").alias("_uses")).where(F.col("_uses") > hot_threshold(total))
    busy = scratch.store(busy, "busy", rows=1)
    if busy.isEmpty():
        return rows.join(values, key, "left")
    known = scratch.store(values.join(F.broadcast(busy), key, "left").withColumn("_uses", F.coalesce("_uses", F.lit(1))), "known")
    return lookup(rows, known, key, total, "_uses").drop("_uses")


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); the root is the smallest node of its component.

    Each task contracts its edges to stars, so that few are left to shuffle. A
    round then hangs every node under the smallest node its root is known under
    (large star) and all its other roots under that (small star), and contracts
    again; rounds go on until each node has one root, which is nobody's node.
    Minima are partial aggregates and hubs are joined by broadcast, so no node is
    a hot group. Loops, repeats and either direction are allowed; a node that has
    loops only is not listed, and an empty edge list gives no node.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    left = edges.count()
    old, stars = [], scratch.store(_contract(edges.where("a <> b").select("a", "b"), left), "stars")
    while True:
        total = stars.count()
        ups = scratch.store(stars.groupBy("node").agg(F.min("root").alias("up")), "ups", rows=total)
        # each node has one root, and no root is a node: the stars are the components
        if ups.count() == total and ups.select(F.col("up").alias("node")).distinct().join(stars.select("node"), "node", "left_semi").isEmpty():
            break
        old += [stars, ups]
        above = ups.select(F.col("node").alias("root"), F.col("up"))
        large = _hub_lookup(scratch, stars, "root", above, total).select("node", F.coalesce("up", "root").alias("root"))
        large = scratch.store(large, "large", rows=total)
        least = scratch.store(large.groupBy("node").agg(F.min("root").alias("up")), "least", rows=total)
        small = _hub_lookup(scratch, large, "node", least, total)
        small = small.select(F.explode(F.array(F.struct("node", F.col("up").alias("root")), F.struct(F.col("root").alias("node"), F.col("up").alias("root")))).alias("e")).select("e.*")
        stars = scratch.store(_contract(small.where("node <> root").distinct(), 2 * total), "stars")
        scratch.drop(*old, large, least)
        old = []
    nodes = ups.select("node").unionByName(ups.select(F.col("up").alias("node"))).distinct()
    out = nodes.join(ups, "node", "left").select("node", F.coalesce("up", "node").alias("root"))
    out = scratch.store(out, "components", rows=2 * left)
    scratch.drop(stars, ups, *old)
    return out
