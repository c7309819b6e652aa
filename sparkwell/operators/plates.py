"""Plates: filling, lineage of wells, shape features, occupancy, plate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import wells
from .storage import checkpointed


def blank_plate(spark, plate_id: str, plate_format: int = 96) -> DataFrame:
    """Every well of a format, empty."""
    return wells.all_wells(spark, plate_format).select(F.lit(plate_id).alias("plate_id"), "well", F.lit("empty").alias("role"), F.lit(None).cast("string").alias("clone_id"), F.lit(None).cast("double").alias("volume_ul"), "place_down")


def fill(plate: DataFrame, rows: DataFrame, order: str = "ordinal", plate_format: int = 96) -> DataFrame:
    """A plate with rows (well, clone_id, volume_ul, ordinal) laid over it; of rows for one well, however written, the last one holds."""
    named = rows.withColumn("well", wells.normalize(F.col("well"), plate_format, strict=True))
    last = named.groupBy("well").agg(F.max_by(F.struct("clone_id", "volume_ul"), order).alias("r"))
    out = plate.join(F.broadcast(last), "well", "left")  # as many rows as a plate has wells
    return out.select("plate_id", "well", F.when(F.col("r").isNotNull(), "sample").otherwise(F.col("role")).alias("role"), F.coalesce("r.clone_id", "clone_id").alias("clone_id"), F.coalesce("r.volume_ul", "volume_ul").alias("volume_ul"), "place_down")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """An upsert on read: the last row of each key."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def read_values(reads: DataFrame, wells_: DataFrame, channel: str) -> DataFrame:
    """Readings of a channel with what is in their wells; unknown wells stay, with nulls."""
    return reads.where(F.col("channel") == channel).join(wells_, ["plate_id", "well"], "left")


def to_plate(clones: DataFrame, order: list[Column], plate_format: int = 96, reserved: tuple[str, ...] = (), down: bool = True) -> DataFrame:
    """Clones with the well each gets in fill order, reserved wells left out. More clones than wells is an error."""
    rows, cols = wells.dims(plate_format)
    at = wells.at_column_major if down else wells.at_row_major
    spec = clones.sparkSession.range(1, rows * cols + 1).select(at(F.col("id"), plate_format).alias("well"), "id").where(~F.col("well").isin(list(reserved)) if reserved else F.lit(True))
    free = spec.select("well", F.row_number().over(W.Window.partitionBy().orderBy("id")).alias("_n"))
    numbered = clones.withColumn("_n", F.row_number().over(W.Window.partitionBy().orderBy(*order)))
    room = rows * cols - len(set(reserved))
    checked = numbered.withColumn("_n", F.when(F.col("_n") <= room, F.col("_n")).otherwise(F.raise_error(F.lit(f"more clones than the {room} free wells"))))
    return checked.join(F.broadcast(free), "_n").drop("_n")


def layout_matches(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether the same clone is in the same well of both plates: one boolean, or one for each value of the columns ``by`` of many plates."""
    keys = [*(by or []), "well"]
    both = a.select(*keys, F.col("clone_id").alias("x")).join(b.select(*keys, F.col("clone_id").alias("y")), keys, "full")
    return both.groupBy(*(by or [])).agg(F.coalesce(F.every(F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("matches"))


def where_is(wells_: DataFrame, plates: DataFrame, clone_id: str) -> DataFrame:
    return wells_.where(F.col("clone_id") == clone_id).join(plates, "plate_id")


def states_of(plates: DataFrame, barcode: str) -> DataFrame:
    """All states of a barcode, with their place from the oldest; a barcode is not unique."""
    own = plates.where(F.col("barcode") == barcode)
    return own.withColumn("state", F.row_number().over(W.Window.partitionBy("barcode").orderBy("created_at", "plate_id")))


def trace_wells(wells_: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_plate, start_well, depth, plate_id, well): ancestors of wells by (source_plate_id, source_well), the start at depth 0.

    A well on a cycle is given once. Each round is a keyed join of the open ends,
    and stops when none is left.
    """
    parent = wells_.where("source_plate_id IS NOT NULL").select(F.col("plate_id").alias("_p"), F.col("well").alias("_w"), "source_plate_id", "source_well")
    key = ["start_plate", "start_well"]
    out = starts.select(F.col("plate_id").alias("start_plate"), F.col("well").alias("start_well"), F.lit(0).alias("depth"), "plate_id", "well")
    ends, depth = out, 0
    while True:
        depth += 1
        step = ends.join(parent, (F.col("plate_id") == F.col("_p")) & (F.col("well") == F.col("_w"))).select(*key, F.lit(depth).alias("depth"), F.col("source_plate_id").alias("plate_id"), F.col("source_well").alias("well"))
        ends = checkpointed(step.join(out.select(*key, "plate_id", "well"), [*key, "plate_id", "well"], "left_anti"))
        if ends.isEmpty():
            return out
        out = out.unionByName(ends.select(*out.columns)) if depth % 16 else checkpointed(out.unionByName(ends.select(*out.columns)))


def infer_roles(values: DataFrame, n_samples: Column | None = None, plate: str = "plate_id") -> DataFrame:
    """Adds ``role``: the n highest wells of each plate are samples, the first well of equals; all are if n is not known."""
    rank = F.row_number().over(W.Window.partitionBy(plate).orderBy(F.desc("od450"), "well"))
    sample = F.lit(True) if n_samples is None else F.coalesce(rank <= n_samples, F.lit(True))
    return values.withColumn("role", F.when(sample, "sample").otherwise("empty"))


#: Names of the shape features of a plate, in order.
FEATURES = ("mean", "sd", "cv", "min", "max", "median", "mad", "iqr", "p90_over_median", "p99_over_median", "top_decile_mean", "top_over_median", "skew", "kurtosis", "frac_over_1", "frac_over_2", "frac_near_ceiling", "frac_near_blank", "range_over_median", "n_samples", "fill_fraction", "blank_median", "blank_sd", "signal_over_blank", "top_over_blank")


def exact_deviation(value: Column) -> Column:
    """Population standard deviation of readings of at most nine places, from exact sums: the order of rows cannot matter."""
    x = value.cast("decimal(16,9)")
    n, one, two = F.count(x), F.sum(x).cast("decimal(18,9)"), F.sum((x * x).cast("decimal(22,14)")).cast("decimal(24,14)")
    return F.sqrt(F.greatest(n.cast("decimal(10,0)") * two - one * one, F.lit(0)).cast("double")) / n


def plate_features(values: DataFrame, plate: str = "plate_id") -> DataFrame:
    """Shape of the readings of each plate over its sample wells, and its own background over the others.

    ``values`` has plate, well, od450 and role. Moments are corrected for bias;
    ratios over nothing are 0, measures of absent blanks null.
    """
    w = W.Window.partitionBy(plate)
    v = F.when(F.col("role") == "sample", F.col("od450"))
    blank = F.when(F.col("role") != "sample", F.col("od450"))
    placed = values.withColumns({"_v": v, "_b": blank, "_rank": F.row_number().over(w.orderBy(F.desc_nulls_last(v), "well"))})
    placed = placed.withColumns({"_n": F.count("_v").over(w), "_median": F.median("_v").over(w)})
    top = F.when(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), F.col("_v"))
    q = lambda p: F.percentile("_v", F.lit(p))
    share = lambda e: F.avg(e.cast("double"))
    agg = placed.groupBy(plate).agg(
        (F.sum(F.col("_v").cast("decimal(16,9)")).cast("double") / F.count("_v")).alias("mean"), exact_deviation(F.col("_v")).alias("sd"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.median("_v").alias("median"),
        F.median(F.abs(F.col("_v") - F.col("_median"))).alias("mad"), (q(0.75) - q(0.25)).alias("iqr"), q(0.9).alias("_p90"), q(0.99).alias("_p99"), F.avg(top).alias("top_decile_mean"),
        F.skewness("_v").alias("_g1"), F.kurtosis("_v").alias("_g2"), share(F.col("_v") > 1.0).alias("frac_over_1"), share(F.col("_v") > 2.0).alias("frac_over_2"), share(F.col("_v") > 3.6).alias("frac_near_ceiling"), share(F.col("_v") < 0.15).alias("frac_near_blank"),
        F.count("_v").cast("double").alias("n_samples"), F.count("*").cast("double").alias("_all"), F.median("_b").alias("blank_median"), F.when(F.count("_b") > 1, exact_deviation(F.col("_b"))).alias("blank_sd"),
    ).where("n_samples > 0")
    n = F.col("n_samples")
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)
    skew = F.when((n > 2) & (F.col("sd") > 0), F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurtosis = F.when((n > 3) & (F.col("sd") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).otherwise(0.0)
    spread = agg.withColumn("_range", F.col("max") - F.col("min"))
    made = spread.withColumns({
        "cv": over("sd", "mean"), "p90_over_median": over("_p90", "median"), "p99_over_median": over("_p99", "median"), "top_over_median": over("top_decile_mean", "median"), "skew": skew, "kurtosis": kurtosis,
        "range_over_median": over("_range", "median"), "fill_fraction": n / F.col("_all"), "signal_over_blank": F.when(F.col("blank_median") != 0, F.col("median") / F.col("blank_median")), "top_over_blank": F.when(F.col("blank_median") != 0, F.col("top_decile_mean") / F.col("blank_median")),
    })
    return made.select(plate, *FEATURES)


def normalise_plan(source: DataFrame, target_conc: float = 10.0, target_volume_ul: float = 100.0, min_transfer_ul: float = 2.0) -> DataFrame:
    """Dilution of every well to one concentration: what to take, what to add, what comes out.

    ``source`` has plate_id, well, concentration. A well without a measured
    concentration gets no transfer; what is clamped to the least transfer or the
    whole volume is flagged.
    """
    have = F.col("concentration")
    need = target_conc * target_volume_ul / have
    take = F.least(F.greatest(need, F.lit(min_transfer_ul)), F.lit(target_volume_ul))
    measured = have.isNotNull() & (have > 0)
    flag = F.when(~measured, "unmeasured").when(need > target_volume_ul, "too dilute").when(need < min_transfer_ul, "below minimum transfer").otherwise("")
    out = F.when(need < min_transfer_ul, have * min_transfer_ul / target_volume_ul).otherwise(F.least(F.lit(target_conc), have * take / target_volume_ul))
    return source.select("plate_id", "well", "concentration", F.when(measured, F.bround(take, 2)).alias("sample_ul"), F.when(measured, F.bround(target_volume_ul - take, 2)).alias("diluent_ul"), F.when(measured, F.round(out, 6)).alias("final_conc"), F.coalesce(flag, F.lit("unmeasured")).alias("flag"))


def optical_density(bound: Column, minutes: float = 15.0, blank: float = 0.05, ceiling: float = 4.0, rate: float = 0.055) -> Column:
    """Colour of a well from what is bound: saturating growth from the blank to the reader's ceiling."""
    return F.lit(blank) + (ceiling - blank) * (1 - F.exp(-rate * F.greatest(bound, F.lit(0.0)) * minutes))
