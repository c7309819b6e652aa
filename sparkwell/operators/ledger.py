"""The ledger: artifacts and their links as a graph, steps and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .storage import checkpointed

ARTIFACT_SCHEMA = "obj_id string, obj_type string, label string, store string, path string, produced_by string, code_version string, params_json string, meta_json string, notes string, created_at string"
LINK_SCHEMA = "parent_id string, child_id string, relationship string"


def register(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts with new rows added; an id that is there already stays as it is."""
    return artifacts.unionByName(new.dropDuplicates(["obj_id"]).join(artifacts.select("obj_id"), "obj_id", "left_anti"), allowMissingColumns=True)


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones added, each once; links that are there stay as often as they are.

    Both are counted by one aggregation, so that a task holds the keys once, not in several sorts and tables.
    """
    keys = ["parent_id", "child_id", "relationship"]
    both = links.select(*keys, F.lit(1).alias("_n")).unionByName(new.select(*keys, F.lit(0).alias("_n")))
    counted = both.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return counted.select(*keys, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "_n")))).select(*keys)


def supersede(links: DataFrame, old_new: DataFrame) -> DataFrame:
    """``old_new`` has (old_id, new_id)."""
    return link(links, old_new.select(F.col("old_id").alias("parent_id"), F.col("new_id").alias("child_id"), F.lit("superseded_by").alias("relationship")))


def current(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """Artifacts that nothing supersedes."""
    gone = links.where("relationship = 'superseded_by'").select(F.col("parent_id").alias("obj_id"))
    return artifacts.join(gone, "obj_id", "left_anti")


def find(artifacts: DataFrame, obj_type: str | None = None, produced_by: str | None = None, **meta: object) -> DataFrame:
    """Artifacts by type, producer and values of top-level fields of their JSON."""
    out = artifacts
    if obj_type is not None:
        out = out.where(F.col("obj_type") == obj_type)
    if produced_by is not None:
        out = out.where(F.col("produced_by") == produced_by)
    for key, value in meta.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        out = out.where(F.get_json_object("meta_json", f"$.{key}") == text)
    return out


def set_meta(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Top-level JSON fields replaced: ``changes`` has (obj_id, key, value), one row for each of both; all values become strings."""
    maps = changes.groupBy("obj_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    old = F.coalesce(F.from_json("meta_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    merged = F.to_json(F.map_concat(kept, F.col("_new")))
    return artifacts.join(maps, "obj_id", "left").withColumn("meta_json", F.when(F.col("_new").isNull(), F.col("meta_json")).otherwise(merged)).drop("_new")


def get(artifacts: DataFrame, obj_id: str) -> Row:
    """The artifact with an id; none is a KeyError."""
    found = artifacts.where(F.col("obj_id") == obj_id).limit(1).collect()
    if not found:
        raise KeyError(f"no artifact {obj_id!r}")
    return found[0]


def parents(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(obj_id, parent_id, relationship): what stands directly above each id."""
    return ids.select("obj_id").distinct().join(links.withColumnRenamed("child_id", "obj_id"), "obj_id").select("obj_id", "parent_id", "relationship")


def children(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(obj_id, child_id, relationship): what stands directly below each id."""
    return ids.select("obj_id").distinct().join(links.withColumnRenamed("parent_id", "obj_id"), "obj_id").select("obj_id", "child_id", "relationship")


#: From so many starts on, those above others of them are looked for first.
MANY_STARTS = 10_000


def lineage(links: DataFrame, starts: DataFrame, direction: str = "up", levels: int | None = None) -> DataFrame:
    """(start, obj_id, depth): everything above or below each start, at the least depth; the start itself is left out.

    Many starts may stand on few others: then what is above those is found first, by the
    same rule, and the others' lineage is that of their parents, one deeper, and the parents. A shortest way leads
    through a parent, so this holds on cycles too. Other starts are searched breadth first: each round joins
    the open ends with the links and keeps what is new, so a cycle ends and an ancestor that
    many paths reach is walked once. Rounds go on until nothing is new; ``levels`` asks for that many only.
    """
    a, b = ("child_id", "parent_id") if direction == "up" else ("parent_id", "child_id")
    edges = links.select(F.col(a).alias("_from"), F.col(b).alias("obj_id")).distinct()
    wanted = starts.select(F.col("obj_id").alias("start")).distinct()
    if levels is not None:
        return _breadth_first(edges, wanted, levels)
    return _lineage(checkpointed(edges), wanted)


def _lineage(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Those above the starts first if they are fewer by a fourth, else all breadth first."""
    starts = checkpointed(starts)
    n = starts.count()
    if n < MANY_STARTS:
        return _breadth_first(edges, starts)
    first = edges.join(starts.withColumnRenamed("start", "_from"), "_from", "left_semi")
    above = checkpointed(first.select(F.col("obj_id").alias("start")).distinct())
    if 4 * above.count() > 3 * n:
        return _breadth_first(edges, starts)
    known = checkpointed(_lineage(edges, above))
    # starts whose lineage is not known yet
    first = first.join(above.withColumnRenamed("start", "_from"), "_from", "left_anti").withColumnRenamed("_from", "start")
    through = first.select("start", F.col("obj_id").alias("_via")).join(known.withColumnRenamed("start", "_via"), "_via").select("start", "obj_id", F.col("depth") + 1)
    found = first.select("start", "obj_id", F.lit(1).alias("depth")).union(through).where(~F.col("start").eqNullSafe(F.col("obj_id")))
    return known.join(starts, "start", "left_semi").select("start", "obj_id", "depth").unionByName(found.groupBy("start", "obj_id").agg(F.min("depth").alias("depth")))


def _breadth_first(edges: DataFrame, starts: DataFrame, levels: int | None = None) -> DataFrame:
    ends = starts.select("start", F.col("start").alias("obj_id")).withColumn("depth", F.lit(0))
    seen, depth = ends, 0
    while levels is None or depth < levels:
        depth += 1
        step = ends.select("start", F.col("obj_id").alias("_from")).join(edges, "_from").select("start", "obj_id").distinct()
        ends = checkpointed(step.join(seen.select("start", "obj_id"), ["start", "obj_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if ends.isEmpty():
            break
        # a plan of many small unions is stored again from time to time
        seen = seen.unionByName(ends) if depth % 16 else checkpointed(seen.unionByName(ends))
    return seen.where("depth > 0")


def doubled_ancestors(parents: DataFrame) -> DataFrame:
    """(obj_id, root, depth) of a forest given as (obj_id, parent_id), by pointer doubling.

    A node whose parent is null, absent or itself is a root. After k rounds every
    node of depth 2**k or less knows its root. As each depth on a path has a node,
    a round that settles none means that no root is left to find: the rest are on
    a cycle or below one, and get a null root and depth.
    """
    known = parents.select(F.col("obj_id").alias("_k"))
    top = F.col("_k").isNull() | (F.col("parent_id") == F.col("obj_id"))
    clean = parents.join(known, F.col("parent_id") == F.col("_k"), "left").select("obj_id", F.when(top, F.col("obj_id")).otherwise(F.col("parent_id")).alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"))
    done, jump = None, checkpointed(clean)
    left = None
    while True:
        settled = jump.where("done").drop("done")
        done = settled if done is None else done.unionByName(settled)
        ends = jump.where("NOT done").drop("done")
        now = ends.count()
        if not now or now == left:
            return done.withColumnRenamed("up", "root").unionByName(ends.select("obj_id", F.lit(None).cast(ends.schema["up"].dataType).alias("root"), F.lit(None).cast("long").alias("depth")))
        left = now
        other = done.select(F.col("obj_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.lit(True).alias("done"))
        other = other.unionByName(ends.select(F.col("obj_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.lit(False).alias("done")))
        jump = checkpointed(ends.join(other, "up").select("obj_id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), "done"))


def step_history(steps: DataFrame, plate_id: str | None = None) -> DataFrame:
    """Steps, those in which a plate is an input or output if one is named."""
    if plate_id is None:
        return steps
    has = lambda c: F.coalesce(F.array_contains(F.from_json(c, "array<string>"), plate_id), F.lit(False))
    return steps.where(has("inputs_json") | has("outputs_json"))


def record(steps: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Steps closed: ``outcomes`` has run_id, status, finished_at, observed (JSON), which is merged over the step's own."""
    patch = outcomes.select("run_id", F.col("status").alias("_status"), F.col("finished_at").alias("_finished"), F.from_json("observed", "map<string,string>").alias("_new"))
    old = F.coalesce(F.from_json("meta_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("_new"), k)), F.col("_new"))
    joined = steps.join(patch, "run_id", "left")
    return joined.withColumns({"status": F.coalesce("_status", "status"), "finished_at": F.coalesce("_finished", "finished_at"), "meta_json": F.when(F.col("_new").isNull(), F.col("meta_json")).otherwise(F.to_json(merged))}).drop("_status", "_finished", "_new")
