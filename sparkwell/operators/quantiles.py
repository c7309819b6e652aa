"""Order statistics from counts of values: what is gathered grows with the distinct values, not with the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def quantiles(rows: DataFrame, group: str, value: str, points: Sequence[float]) -> DataFrame:
    """(group, quantiles): the quantiles of each group at ``points``, in their order, with linear interpolation; exact.

    Values are counted with partial aggregation; running counts place the two
    values around each point. No task holds a group's rows, and equal rows give
    equal results in any order. Nulls count nowhere; a group of nulls has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    by_value = W.Window.partitionBy(group).orderBy("_v")
    placed = counts.withColumns({"_to": F.sum("_n").over(by_value), "_all": F.sum("_n").over(W.Window.partitionBy(group))})
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])
    each = placed.select(group, "_v", "_n", "_to", "_all", F.explode(asked).alias("_a"))
    at = F.col("_a.p") * (F.col("_all") - 1)
    holds = lambda rank: (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n"))
    low, high = F.floor(at), F.ceil(at)
    found = each.where(holds(low) | holds(high)).groupBy(group, F.col("_a.i").alias("_i")).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"), F.max(at - low).alias("_part")
    )
    value_at = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return found.select(group, F.struct("_i", value_at.alias("q")).alias("_x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["q"]).alias("quantiles"))
