"""Near-duplicate classes: BagMinHash bands propose, multiset overlap decides.

1. Equal texts become one node. Nodes get signatures; each band of a signature
   is a bucket. Buckets with the same members are one bucket.
2. The members of a bucket are first compared with its best connected one, the
   center; linked members become classes. Buckets with one center are one group.
   What remains to be compared is who is not in the class of the center, against
   the whole group. Large groups are compared in blocks.
3. In a block, each text is compared with all others of another class at once,
   by exact multiset overlap. A block returns the links that join its classes,
   not all pairs: at most one fewer than its members.
4. Classes are the connected components of the links. Each keeps its closest link
   as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash as bag
from .components import connected_components
from .exact_dedup import keep_marked
from .shared import Scratch, clean_text, lookup, matching, mix64, release_memory, slices, utf8

#: Members that are compared in one piece; a larger bucket is cut into blocks of about this size.
BLOCK = 512
#: Members that are compared with one copy of the smallest member of their bucket.
STAR_ROWS = 1000
#: Bytes of text whose multisets a worker holds at once; a block with more is compared in parts.
PART_BYTES = 1 << 20


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(batch.num_columns - 1))
        blobs = []
        for i, j in slices(offsets):
            found = bag.signatures(*bag.multisets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i)
            raw = found.tobytes()
            size = bag.SLOTS * 2
            blobs += [raw[k * size : (k + 1) * size] if found[k].any() else None for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], names=[*batch.schema.names[:-1], "signature"])
    release_memory()


def sign_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, sha, signature) of each document; a text without words has no signature."""
    body = clean_text(text)
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(body, 256)).alias("sha"), body.alias("_text"))
    return rows.mapInArrow(_signed, rows.drop("_text").schema.add("signature", "binary"))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, bag.SLOTS)
        keys = bag.band_keys(signature)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, bag.BANDS))], names=["bucket", "node"])


class _Sets:
    """The multisets of several texts as sets of (shingle, occurrence) numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        doc, shingle, weight = [], [], []
        for i, j in slices(offsets):
            d, s, w = bag.multisets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc.append(d + i)
            shingle.append(s)
            weight.append(w)
        doc, shingle, weight = (np.concatenate(x) for x in (doc, shingle, weight))
        # the k-th occurrence of a shingle is an element of its own: overlap becomes intersection
        at = np.repeat(np.arange(len(doc)), weight)
        occurrence = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
        values, self.element = np.unique(mix64(shingle[at] + (occurrence.astype(np.uint64) << np.uint64(44))), return_inverse=True)
        self.bounds = np.searchsorted(doc[at], np.arange(n + 1))
        self.size = np.diff(self.bounds)
        self.mark = np.zeros(len(values), bool)

    def against(self, one: int, others: np.ndarray) -> np.ndarray:
        """Similarity of one text with each of others."""
        own = self.element[self.bounds[one] : self.bounds[one + 1]]
        self.mark[own] = True
        sizes = self.size[others]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.bounds[others] - starts, sizes) + np.arange(sizes.sum())
        hits = self.mark[self.element[at]]
        common = np.add.reduceat(np.r_[hits, False], starts) * (sizes > 0)
        self.mark[own] = False
        return common / np.maximum(self.size[one] + sizes - common, 1)


def _links_of(nodes: np.ndarray, classes: np.ndarray, left: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Links that join the classes of a block, with their similarity. Rows with ``left`` are compared with all rows, the others only with those."""
    root, links = classes.copy(), []
    parts = list(slices(offsets, PART_BYTES))
    for k, first in enumerate(parts):
        for second in parts[k:]:
            rows = np.arange(*first) if first == second else np.r_[np.arange(*first), np.arange(*second)]
            if not left[rows].any() or (root[rows] == root[rows[0]]).all():
                continue
            spans = [data[offsets[i] : offsets[j]] for i, j in ([first] if first == second else [first, second])]
            sets = _Sets(np.concatenate(spans), np.r_[0, np.cumsum(np.diff(offsets)[rows])])
            inside = len(rows) if first == second else first[1] - first[0]
            for i in np.flatnonzero(left[rows]).tolist():
                # inside a part the later ones; between parts those of the other part; the rows that are not left in any case
                where = np.arange(len(rows))
                other = where > i if first == second else (where >= inside) != (i >= inside)
                if first == second:
                    other |= ~left[rows] & (where != i)
                others = np.flatnonzero(other & (root[rows] != root[rows[i]]))
                if not len(others):
                    continue
                found = sets.against(i, others)
                alike = found >= least
                for j, overlap in zip(rows[others[alike]].tolist(), found[alike].tolist(), strict=True):
                    if root[j] != root[rows[i]]:
                        links.append((int(nodes[rows[i]]), int(nodes[j]), overlap))
                        root[root == root[j]] = root[rows[i]]
    return links


def _compared(least: float):
    """Streams rows sorted by (bucket, block) and compares one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def flush() -> list[tuple[int, int, float]]:
            if not held:
                return []
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {n: table.column(n).chunk(0) for n in ("node", "class", "left", "text")}
            nodes = columns["node"].to_numpy()
            _, first = np.unique(nodes, return_index=True)
            data, offsets = utf8(columns["text"])
            return _links_of(nodes, columns["class"].to_numpy(), columns["left"].to_numpy(zero_copy_only=False) & np.isin(np.arange(len(nodes)), first), data, offsets, least)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            links = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if current != tuple(keys[i]):
                    links += flush()
                    held, current = [], tuple(keys[i])
                held.append(batch.slice(i, j - i))
            yield _link_batch(links)
        yield _link_batch(flush())
        held.clear()
        release_memory()

    return run


_LINKS = "a long, b long, overlap double"


def _link_batch(links: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "overlap"])


def _starred(least: float):
    """Streams rows (center, salt, spoke, node, text) sorted by center, salt and spoke; the center's own text comes first, and all others are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shingle, weight = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            center, salt, spoke, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, offsets = utf8(batch.column(4))
            cuts = np.flatnonzero(np.r_[True, (center[1:] != center[:-1]) | (salt[1:] != salt[:-1])])
            links = []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(center)], strict=True):
                if not spoke[i]:
                    current = center[i]
                    shingle, weight = bag.multisets(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[1:]
                    i += 1
                for p, q in slices(offsets[i : j + 1]):
                    p, q = p + i, q + i
                    doc, s, w = bag.multisets(data[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p])
                    at = np.minimum(np.searchsorted(shingle, s), len(shingle) - 1)
                    hit = shingle[at] == s
                    common = np.bincount(doc[hit], np.minimum(w[hit], weight[at[hit]]), minlength=q - p)
                    overlap = common / (np.bincount(doc, w, minlength=q - p) + weight.sum() - common)
                    links += [(int(node[p + k]), int(current), float(overlap[k])) for k in np.flatnonzero(overlap >= least).tolist()]
            yield _link_batch(links)
        release_memory()

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = bag.SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: key, ``class_id``, ``class_size``, ``n_texts``, ``kept``, ``text_sha256``, ``n_links``, ``link``.

    A class is a connected component of the links between texts whose multisets
    of 5-word shingles overlap by ``least`` or more, together with the copies of
    each text. ``class_id`` is the largest key of the class, whose row is kept
    (one of them, if rows repeat it); ``class_size`` counts rows, ``n_texts``
    different texts. ``n_links`` counts the verified links that hold the class
    together, ``link`` is the closest of them: the SHA-256 of its two texts and
    their overlap; 0 and null where a text has copies only. A text without words,
    such as a null or empty one, is linked to none, and is in a class with its
    copies only. A null key is smaller than any. Columns of other names are
    ignored; an empty table gives no row.

    The chance that a pair at the least similarity meets in no bucket is
    (1 - 0.8**4)**32, about 5e-8; there is no cap on partners.
    """
    return _near(scratch or Scratch(docs.sparkSession, "near-dedup"), docs, key, text, least)[0]


def _near(scratch: Scratch, docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, int]:
    """The result of ``near_duplicates`` and the number of its rows."""
    signed = scratch.store(sign_documents(docs, key, text), "signatures")
    total = signed.count()
    texts = signed.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("stays"), F.first("signature").alias("signature"))
    nodes = scratch.store(texts.withColumn("node", F.monotonically_increasing_id()), "nodes", rows=total)

    # buckets with two members or more; those with the same members are compared once
    banded = nodes.where("signature IS NOT NULL").select("node", "signature").mapInArrow(_banded, "bucket long, node long")
    spread = [F.sum(F.xxhash64(F.lit(s), "node").cast("decimal(20,0)")).alias(f"sum{s}") for s in (1, 2)]
    stats = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), *spread).where("n > 1")
    stats = scratch.store(stats.groupBy("n", "low", "sum1", "sum2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "low"), "buckets", rows=total)
    met = scratch.store(matching(banded, stats, "bucket", total * bag.BANDS).select("bucket", "node", "n"), "met", rows=4 * total)
    # the center of a bucket is the member that meets most others in all its buckets: of a text and its copies the text
    # itself, which is nearer to each copy than they are to each other
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree"))
    centers = met.join(degrees, "node").groupBy("bucket").agg(F.first("n").alias("n"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("low"))
    centers = scratch.store(centers, "centers", rows=total)
    members = scratch.store(lookup(met.drop("n"), centers, "bucket", met.count()).select("bucket", "node", "n", "low"), "members", rows=4 * total)

    wanted = scratch.store(members.select("node").distinct().join(nodes.select("node", "sha", "n"), "node"), "wanted", rows=total)
    bodies = matching(docs.select(F.unhex(F.sha2(clean_text(text), 256)).alias("sha"), clean_text(text).alias("text")), wanted, "sha", total)
    bodies = scratch.store(bodies.groupBy("node").agg(F.first("text").alias("text")), "bodies")

    links = _compare_buckets(scratch, members, bodies, least)
    scratch.drop(stats, met, centers, wanted, members, bodies)
    roots = connected_components(links, scratch)
    # one row for each text: its class, and what is known of that: rows, texts, the largest key, links and the closest of these
    placed = nodes.select("node", "sha", "n", "stays").join(roots, "node", "left").select("node", "sha", "n", "stays", F.coalesce("root", "node").alias("root"))
    placed = scratch.store(placed, "placed", rows=total)
    held = links.join(roots, links["a"] == roots["node"]).groupBy("root").agg(F.count("*").alias("n_links"), F.max(F.struct("overlap", "a", "b")).alias("top"))
    for end in ("a", "b"):
        held = held.join(nodes.select(F.col("node").alias("_n"), F.col("sha").alias(f"sha_{end}")), F.col(f"top.{end}") == F.col("_n")).drop("_n")
    classes = placed.groupBy("root").agg(F.sum("n").alias("class_size"), F.count("*").alias("n"), F.max("stays").alias("best"))
    classes = classes.join(held.select("root", "n_links", "sha_a", "sha_b", "top.overlap"), "root", "left")
    classes = scratch.store(classes, "classes", rows=total)
    by_text = lookup(placed.withColumnRenamed("n", "copies"), classes, "root", total)
    by_text = scratch.store(by_text.select("sha", F.col("copies").alias("n"), "class_size", F.col("n").alias("n_texts"), "best", "n_links", "sha_a", "sha_b", "overlap"), "by-text", rows=total)
    scratch.drop(nodes, links, roots, placed, classes)
    out = lookup(signed.select("id", "row", "sha"), by_text, "sha", total)
    link = F.struct(F.lower(F.hex("sha_a")).alias("a"), F.lower(F.hex("sha_b")).alias("b"), "overlap")
    out = out.select(
        F.col("id").alias(key),
        F.col("best.id").alias("class_id"),
        "class_size",
        "n_texts",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links") > 0, link).alias("link"),
    )
    return out, total


def _star_links(spokes: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links of members with their centers. A center with many members is dealt out in copies, each for ``STAR_ROWS`` of them, about."""
    copies = F.ceil(F.col("n") / STAR_ROWS).cast("int")
    dealt = spokes.select("center", F.pmod(F.xxhash64("node"), copies).cast("int").alias("salt"), F.lit(True).alias("spoke"), "node")
    centers = spokes.groupBy("center").agg(F.max("n").alias("n"))
    centers = centers.select("center", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(False).alias("spoke"), F.col("center").alias("node"))
    parts = int(spokes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.unionByName(centers).join(bodies, "node").select("center", "salt", "spoke", "node", "text")
    return rows.repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", "spoke").mapInArrow(_starred(least), _LINKS)


def _compare_buckets(scratch: Scratch, members: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links (a, b, overlap) that join all similar members of every bucket.

    ``members`` has bucket, node, n (of the bucket) and low, the bucket's center.
    Buckets with one center are one group: members that meet in many buckets are
    compared once. A group holds all pairs of its buckets, and perhaps more.
    """
    spokes = members.where("node <> low").groupBy(F.col("low").alias("center"), "node").agg(F.max("n").alias("n"))
    spokes = scratch.store(spokes, "spokes", rows=members.count())
    total = spokes.count()
    found = scratch.store(_star_links(spokes, bodies, least), "star-links")
    roots = connected_components(found, scratch)
    groups = spokes.groupBy("center").agg((F.count("*") + 1).alias("n"))
    groups = groups.join(roots.withColumnRenamed("node", "center"), "center", "left").select("center", "n", F.coalesce("root", "center").alias("center_class"))
    groups = scratch.store(groups, "groups", rows=total)
    # who is linked to the center itself is in its class; the others may be, through others
    linked = found.select(F.col("a").alias("node"), F.col("b").alias("center"))
    others = spokes.join(linked, ["node", "center"], "left_anti").join(roots, "node", "left").select("center", F.coalesce("root", "node").alias("class"))
    rest = lookup(others, groups, "center", total).where("class <> center_class").groupBy("center", "n", "center_class").agg(F.count("*").alias("rest"))
    # a group of two has no further pair
    rest = rest.where("n > 2")
    blocks, parts = (F.ceil(size / BLOCK).cast("int") for size in (F.col("rest"), F.col("n") - F.col("rest")))
    counts = scratch.store(rest.select("center", "n", "center_class", blocks.alias("blocks"), parts.alias("parts")), "open-groups", rows=total)
    if counts.isEmpty():
        return found
    every = spokes.select("center", "node").unionByName(counts.select("center", F.col("center").alias("node")))
    rows = lookup(every, counts, "center", total).where("blocks IS NOT NULL").join(roots, "node", "left")
    rows = rows.withColumn("class", F.coalesce("root", "node")).withColumn("left", F.col("class") != F.col("center_class")).drop("root", "center_class").withColumnRenamed("center", "bucket")
    rows = scratch.store(rows, "open-members", rows=total)
    small = rows.where(F.col("n") <= BLOCK).select("bucket", F.lit(0).cast("long").alias("block"), "node", "class", "left")
    # a large group: the rows that are left are dealt into blocks, which meet each other (i <= j) and every part of the
    # others; these, of one class, are then the rows that are compared with all
    large = rows.where(F.col("n") > BLOCK).withColumns({"own": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "part": F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int")})
    more = small
    if not large.isEmpty():
        open_ = large.where("left")
        pairs = open_.select("bucket", "node", "class", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j))")).alias("p"))
        pairs = pairs.select("bucket", (F.col("p.i").cast("long") * 1_000_003 + F.col("p.j") + 1).alias("block"), "node", "class", F.lit(True).alias("left"))
        cross_open = open_.select("bucket", "node", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.col("own").alias("i"), F.lit(False).alias("left"))
        cross_rest = large.where("NOT left").select("bucket", "node", "class", F.col("part").alias("j"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.lit(True).alias("left"))
        cross = cross_open.unionByName(cross_rest).select("bucket", (-(F.col("i").cast("long") * 1_000_003 + F.col("j") + 1)).alias("block"), "node", "class", "left")
        more = small.unionByName(pairs).unionByName(cross)
    links = scratch.store(found.unionByName(_in_blocks(more, bodies, least)), "links")
    scratch.drop(spokes, found, roots, groups, counts, rows)
    return links


def _in_blocks(rows: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    joined = rows.join(bodies, "node").select("bucket", "block", "node", "class", "left", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_compared(least), _LINKS)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = bag.SIMILARITY) -> DataFrame:
    """The documents that stay, all their columns: one row of each class."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    return keep_marked(scratch, docs, *_near(scratch, docs, key, text, least), key, text)
