"""Selection of diverse members: quotas, length bins, acceptance, greedy sampling."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..kernels import greedy
from .quantiles import quantiles
from .similar import worst_pairs
from .spread import broadcast_within
from .storage import checkpointed


@dataclass(frozen=True)
class Panel:
    """Genes with the fractions that a selection aims at, and a light chain."""

    name: str
    fractions: dict[str, float] = field(default_factory=dict)
    light_chain: str = ""

    def quotas(self, n: int) -> dict[str, int]:
        """Largest remainders, one at least for each gene, what is too much taken from the largest."""
        if n < len(self.fractions):
            raise ValueError(f"{n} picks are fewer than {len(self.fractions)} genes")
        total = sum(self.fractions.values())
        exact = {x: n * f / total for x, f in self.fractions.items()}
        out = {x: int(v) for x, v in exact.items()}
        order = sorted(exact, key=lambda x: (out[x] - exact[x], list(exact).index(x)))
        for x in order[: n - sum(out.values())]:
            out[x] += 1
        out = {x: max(1, k) for x, k in out.items()}
        while sum(out.values()) > n:
            out[max(out, key=out.get)] -= 1
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x, f) for x, f in self.fractions.items()], "v_gene string, fraction double")


PANELS: dict[str, Panel] = {}


def register_panel(panel: Panel) -> Panel:
    if panel.name in PANELS:
        raise ValueError(f"panel {panel.name} is registered already")
    return PANELS.setdefault(panel.name, panel)


register_panel(Panel("default-v1", {"IGHV3-23": 0.60, "IGHV1-69": 0.25, "IGHV3-53": 0.15}, "IGKV1-39"))
register_panel(Panel("single-v1", {"IGHV3-23": 1.0}, "IGKV1-39"))


def quotas(fractions: DataFrame, n: int) -> DataFrame:
    """``Panel.quotas`` as a query over (v_gene, fraction), a row for each gene: floors, then largest remainders, then one at least."""
    every = W.Window.partitionBy()
    exact = fractions.select("v_gene", (n * F.col("fraction") / F.sum("fraction").over(every)).alias("exact"))
    low = exact.withColumn("low", F.floor(F.round("exact", 9)))
    rank = F.row_number().over(W.Window.partitionBy().orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 9)), "v_gene"))
    return low.withColumn("quota", F.greatest(F.lit(1), F.col("low") + (rank <= n - F.sum("low").over(every)).cast("int")).cast("long")).select("v_gene", "quota")


def length_bins(rows: DataFrame, bins: int = 4) -> DataFrame:
    """The bin of every CDR3 length inside its gene: quantiles with linear interpolation, equal edges merged, the left edge in the first bin."""
    edges = quantiles(rows, "v_gene", "cdr3_len", [i / bins for i in range(bins + 1)]).select("v_gene", F.array_distinct("quantiles").alias("edges"))
    inner = F.expr("filter(edges, (e, i) -> i > 0 AND i < size(edges) - 1)")
    return rows.join(broadcast_within(edges), "v_gene").withColumn("bin", F.size(F.filter(inner, lambda e: F.col("cdr3_len") > e)).cast("long")).drop("edges")


def worst_pair(picked: DataFrame) -> DataFrame:
    """The two picks that are most alike: (a, b, identity), the pair of least ids of equal ones; no row for less than two picks."""
    return worst_pairs(picked)


@dataclass(frozen=True)
class Spec:
    """What a selection must meet."""

    max_identity: float = 0.80
    min_length_span: int = 8
    min_genes: int = 1
    min_per_gene: int = 1

    def check(self, picked: DataFrame) -> DataFrame:
        """One row of measures and whether all are met; fewer than two picks have identity 0."""
        genes = picked.groupBy("v_gene").agg(F.count("*").alias("k"), F.min("cdr3_len").alias("low"), F.max("cdr3_len").alias("high"))
        shape = genes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.max("high") - F.min("low"), F.lit(0)).cast("long").alias("length_span"), F.count("v_gene").alias("n_genes"), F.coalesce(F.min("k"), F.lit(0)).alias("min_gene"))
        worst = worst_pair(picked).agg(F.coalesce(F.max("identity"), F.lit(0.0)).alias("max_identity"))
        met = (F.col("max_identity") <= self.max_identity) & (F.col("length_span") >= self.min_length_span) & (F.col("n_genes") >= self.min_genes) & (F.col("min_gene") >= self.min_per_gene)
        return shape.join(worst, how="cross").withColumn("passed", met)


#: Most loops of a group that one task chooses from.
BLOCK = 2048


def core_set(rows: DataFrame, keys: list[str], k: int, seed: int = 42, sequence: str = "cdr3_aa", block: int = 0) -> DataFrame:
    """Rows of which every group has at most a block: in rounds, the ``k`` farthest points of each block of a larger group.

    Farthest points compose: the farthest ``k`` of those that blocks have chosen
    leave no loop farther from a pick than four times the best radius there is.
    Blocks are dealt by a hash, so one large group is worked on by many tasks; a
    group that fits is left as it is, and chosen from as a whole. ``block``: its
    size, ``BLOCK`` or four times ``k`` if that is more.
    """
    size = max(block or BLOCK, 4 * k)
    while True:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= size:
            return rows
        parts = F.ceil(F.col("_n") / (size / 2)).cast("int")  # halves, so that uneven ones fit too
        dealt = rows.join(broadcast_within(counts), keys).withColumn("_part", F.when(F.col("_n") <= size, 0).otherwise(F.pmod(F.xxhash64(sequence, "seq_id"), parts)))
        schema = T.StructType([f for f in dealt.schema if f.name not in ("_n", "_part")])

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("seq_id", ignore_index=True)
            at = greedy.farthest(group[sequence].tolist(), k, seed) if group["_n"][0] > size else range(len(group))
            return group.iloc[list(at)][schema.names]

        rows = checkpointed(dealt.groupBy(*keys, "_part").applyInPandas(choose, schema))


def sample(candidates: DataFrame, n: int, panel: Panel, seed: int = 42, bins: int = 4) -> DataFrame:
    """Stratified picks: gene quotas, length bins, greedy farthest points in each bin.

    Loops are distinct in the result. A bin that is short is made up by its gene;
    a gene without candidates is made up by the others. No bin is chosen from in
    one task before it is down to ``BLOCK`` loops (see ``core_set``).
    """
    want = panel.quotas(n)
    one = candidates.where(F.col("v_gene").isin(*want)).groupBy("cdr3_aa").agg(F.min_by(F.struct("seq_id", "v_gene", "cdr3_len"), "seq_id").alias("r")).select("r.*", "cdr3_aa")
    binned = length_bins(one, bins).withColumn("quota", F.create_map(*[F.lit(x) for p in want.items() for x in p])[F.col("v_gene")])
    counts = binned.groupBy("v_gene").agg(F.count_distinct("bin").alias("n_bins"))
    ready = core_set(binned.join(broadcast_within(counts), "v_gene"), ["v_gene", "bin"], max(n, *want.values()), seed)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq_id", ignore_index=True)
        quota, k, b = int(rows.quota[0]), int(rows.n_bins[0]), int(rows.bin[0])
        share = quota // k + (b < quota % k)
        # picks first, then the rest in greedy order: what other bins lack is made up from there
        order = greedy.farthest(rows.cdr3_aa.tolist(), min(len(rows), max(quota, n)), seed)
        out = rows.iloc[order].copy()
        out["place"] = range(len(out))
        out["primary"] = out.place < share
        return out[["seq_id", "v_gene", "cdr3_aa", "cdr3_len", "bin", "quota", "place", "primary"]]

    ranked = ready.groupBy("v_gene", "bin").applyInPandas(choose, "seq_id string, v_gene string, cdr3_aa string, cdr3_len int, bin long, quota long, place long, primary boolean")
    in_gene = W.Window.partitionBy("v_gene").orderBy(F.desc("primary"), "place", "bin", "seq_id")
    ranked = ranked.withColumn("gene_rank", F.row_number().over(in_gene))
    overall = W.Window.partitionBy().orderBy(F.col("gene_rank") > F.col("quota"), "gene_rank", "v_gene")  # a few hundred rows for each pick at most
    return ranked.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= n).select("seq_id", "v_gene", "cdr3_aa", "cdr3_len", (F.col("rank") - 1).alias("rank"))


def group_for_plate(picked: DataFrame, by: str = "v_gene", sequence: str = "cdr3_aa") -> DataFrame:
    """Picks with ``place``: groups by descending size, each ordered so that neighbours are alike; rows without a group go."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq_id", ignore_index=True)
        return rows.iloc[greedy.seriate(rows[sequence].tolist())].assign(inside=range(len(rows)))

    known = picked.where(F.col(by).isNotNull())
    sizes = known.groupBy(by).agg(F.count("*").alias("group_size"))
    ordered = known.groupBy(by).applyInPandas(order, T.StructType([*known.schema, T.StructField("inside", T.LongType())])).join(sizes, by)
    place = F.row_number().over(W.Window.partitionBy().orderBy(F.desc("group_size"), by, "inside"))
    return ordered.withColumn("place", place - 1).drop("inside", "group_size")
