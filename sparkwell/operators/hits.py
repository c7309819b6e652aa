"""Hit calling on plate pairs: plate health, callers, scoring against a truth.

All pairs are in one frame keyed by ``pair_id``; every statistic of a plate is a
window or an aggregate over that key, so that one shuffle serves a whole caller.
A plate has at most 384 wells, which bounds each window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..registry import Registry

#: Defaults of the callers.
DEFAULTS = {"min_ratio": 3.0, "min_signal": 0.2, "z_threshold": 3.5, "saturation_od": 3.6, "reader_resolution": 0.001, "uncallable_dynamic_range": 10.0, "degraded_dynamic_range": 25.0, "blank_multiple": 4.0, "min_floor": 0.05}
CALLABLE, DEGRADED, UNCALLABLE = "callable", "degraded", "uncallable"
PAIR = "pair_id"
CALLERS: Registry[Callable[..., DataFrame]] = Registry("caller")


def pair_truth(target: DataFrame, control: DataFrame) -> DataFrame:
    """Both readings of each well of a pair, their ratio (control at least 1e-6) and difference."""
    keys = [PAIR, "well"]
    both = target.withColumnRenamed("od450", "od450_target").join(control.select(*keys, F.col("od450").alias("od450_control")), keys)
    return both.withColumn("ratio", F.col("od450_target") / F.greatest("od450_control", F.lit(1e-6))).withColumn("delta", F.col("od450_target") - F.col("od450_control"))


def _with_background(frame: DataFrame, blanks: DataFrame | None) -> DataFrame:
    """Adds ``background`` (median of the blanks, or of the lowest tenth, three at least) and ``top`` (mean of the highest tenth, one at least)."""
    plate = W.Window.partitionBy(PAIR)
    n = F.count("*").over(plate)
    up = F.row_number().over(plate.orderBy("od450_target", "well"))
    down = F.row_number().over(plate.orderBy(F.desc("od450_target"), "well"))
    ranked = frame.withColumns({"_n": n, "_up": up, "_down": down})
    low = F.median(F.when(F.col("_up") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 10)), F.col("od450_target"))).over(plate)
    top = F.avg(F.when(F.col("_down") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), F.col("od450_target"))).over(plate)
    out = ranked.withColumns({"_low": low, "top": top})
    if blanks is None:
        out = out.withColumn("background", F.col("_low"))
    else:
        measured = blanks.groupBy(PAIR).agg(F.median("od450").alias("_blank"))
        out = out.join(measured, PAIR, "left").withColumn("background", F.coalesce("_blank", "_low")).drop("_blank")
    return out.drop("_n", "_up", "_down", "_low")


def _verdict(dynamic: Column, p: dict) -> Column:
    return F.when(dynamic < p["uncallable_dynamic_range"], UNCALLABLE).when(dynamic < p["degraded_dynamic_range"], DEGRADED).otherwise(CALLABLE)


def _dynamic() -> Column:
    return F.when(F.col("background") > 0, F.col("top") / F.col("background")).otherwise(F.lit(float("inf")))


def plate_health(frame: DataFrame, blanks: DataFrame | None = None, **params) -> DataFrame:
    """Per pair: background, top-decile mean, dynamic range, saturated share, verdict. Saturation is told, not refused on."""
    p = DEFAULTS | params
    per = _with_background(frame, blanks).groupBy(PAIR).agg(F.first("background").alias("background"), F.first("top").alias("top"), F.count("*").alias("n_wells"), F.avg((F.col("od450_target") >= p["saturation_od"]).cast("double")).alias("saturated"))
    return per.withColumn("dynamic_range", _dynamic()).withColumn("verdict", _verdict(F.col("dynamic_range"), p))


def reasons(health: DataFrame, **params) -> DataFrame:
    """Health with ``reasons``, a sentence for each thing that speaks against the plate: too little range, and wells at the ceiling, which are called but not ranked."""
    p = DEFAULTS | params
    times = F.format_string("%.1f", "dynamic_range")
    told = F.array(
        F.when(F.col("verdict") == UNCALLABLE, F.concat(F.lit("the highest tenth is only "), times, F.lit(f" times the background, below {p['uncallable_dynamic_range']:.0f}: there is no range to call hits in"))),
        F.when(F.col("verdict") == DEGRADED, F.concat(F.lit("the highest tenth is "), times, F.lit(f" times the background, below {p['degraded_dynamic_range']:.0f}: calls are usable but worse"))),
        F.when(F.col("saturated") > 0, F.concat(F.format_string("%.0f", 100 * F.col("saturated")), F.lit("% of the wells are at the reader's ceiling: they are called but cannot be ranked"))),
    )
    return health.withColumn("reasons", F.filter(told, lambda x: x.isNotNull()))


def plate_context(frame: DataFrame, truth: DataFrame) -> DataFrame:
    """(pair_id, dynamic_range, saturated, binders): what a verdict could rest on, from the readings themselves."""
    health = plate_health(frame).select(PAIR, "dynamic_range", "saturated")
    return health.join(truth.groupBy(PAIR).agg(F.count_if("is_binder").alias("binders")), PAIR, "left").na.fill(0, ["binders"])


def verdict_table(scored: DataFrame, caller: str = "ratio_over_blank") -> DataFrame:
    """(verdict, precision, recall, f1, tp, fp, plates) of one caller, so that a plate counts once."""
    one = scored.where(F.col("caller") == caller)
    return one.groupBy("verdict").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count_distinct(PAIR).alias("plates"))


def band_table(scored: DataFrame, context: DataFrame, value: str, edges: tuple[float, ...], caller: str = "ratio_over_blank") -> DataFrame:
    """(band, precision, recall, f1, plates) of one caller over plates with a binder, by bands of a property of the plate."""
    live = scored.where(F.col("caller") == caller).join(context.where("binders > 0").select(PAIR, value), PAIR)
    banded = live.withColumn("band", band(F.col(value), edges)).where("band IS NOT NULL")
    return banded.groupBy("band").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("plates"))


def _calls(frame: DataFrame, name: str, score: Column, is_hit: Column, p: dict, more: tuple[str, ...] = ()) -> DataFrame:
    flag = F.when(F.col("od450_target") >= p["saturation_od"], "saturated").when(F.col("od450_target") < p["min_signal"], "below floor").otherwise("")
    return frame.select(PAIR, "well", "od450_target", "od450_control", F.lit(name).alias("caller"), score.alias("score"), F.coalesce(is_hit, F.lit(False)).alias("is_hit"), flag.alias("flag"), _verdict(_dynamic(), p).alias("verdict"), *more)


def _ratio() -> Column:
    return F.col("od450_target") / F.greatest("od450_control", F.lit(1e-6))


@CALLERS.register("fixed_ratio", needs_blanks=False)
def fixed_ratio(frame: DataFrame, blanks: DataFrame | None = None, **params) -> DataFrame:
    """Ratio over a threshold, and a fixed floor."""
    p = DEFAULTS | params
    hit = (_ratio() >= p["min_ratio"]) & (F.col("od450_target") >= p["min_signal"])
    return _calls(_with_background(frame, blanks), "fixed_ratio", _ratio(), hit, p)


def _over_blank(p: dict) -> Column:
    floor = F.greatest(F.col("background") * p["blank_multiple"], F.lit(p["min_floor"]))
    return (_ratio() >= p["min_ratio"]) & (F.col("od450_target") >= floor)


@CALLERS.register("ratio_over_blank", needs_blanks=True)
def ratio_over_blank(frame: DataFrame, blanks: DataFrame | None = None, **params) -> DataFrame:
    """Ratio over a threshold, and a floor that is a multiple of the plate's own background."""
    p = DEFAULTS | params
    return _calls(_with_background(frame, blanks), "ratio_over_blank", _ratio(), _over_blank(p), p)


def _with_z(frame: DataFrame, p: dict) -> DataFrame:
    """Adds ``z``: difference from the plate's median in scaled MADs; if the MAD is nil, in the deviation of the middle half, floored at the reader's resolution."""
    plate = W.Window.partitionBy(PAIR)
    delta = frame.withColumn("_delta", F.col("od450_target") - F.col("od450_control"))
    centred = delta.withColumn("_centre", F.median("_delta").over(plate))
    spread = centred.withColumn("_mad", F.median(F.abs(F.col("_delta") - F.col("_centre"))).over(plate) * 1.4826)
    quartiles = spread.withColumns({"_q1": F.percentile("_delta", F.lit(0.25)).over(plate), "_q3": F.percentile("_delta", F.lit(0.75)).over(plate)})
    middle = F.stddev_pop(F.when(F.col("_delta").between(F.col("_q1"), F.col("_q3")), F.col("_delta"))).over(plate)
    scale = F.when(F.col("_mad") <= 1e-9, F.greatest(F.coalesce(middle, F.lit(0.0)), F.lit(p["reader_resolution"]))).otherwise(F.col("_mad"))
    out = quartiles.withColumn("_scale", scale).withColumn("z", (F.col("_delta") - F.col("_centre")) / F.col("_scale"))
    return out.drop("_delta", "_centre", "_mad", "_q1", "_q3", "_scale")


def _by_z(p: dict) -> Column:
    return (F.col("z") >= p["z_threshold"]) & (F.col("od450_target") >= p["min_signal"])


@CALLERS.register("robust_z", needs_blanks=False)
def robust_z(frame: DataFrame, blanks: DataFrame | None = None, **params) -> DataFrame:
    """Difference of the readings against the plate's own robust spread, and a fixed floor."""
    p = DEFAULTS | params
    return _calls(_with_z(_with_background(frame, blanks), p), "robust_z", F.col("z"), _by_z(p), p)


@CALLERS.register("ratio_and_z", needs_blanks=True)
def ratio_and_z(frame: DataFrame, blanks: DataFrame | None = None, **params) -> DataFrame:
    """Hits of both; the score is z, the ratio stands beside it."""
    p = DEFAULTS | params
    both = _with_z(_with_background(frame, blanks), p).withColumn("ratio", _ratio())
    return _calls(both, "ratio_and_z", F.col("z"), _over_blank(p) & _by_z(p), p, ("ratio",))


def call(frame: DataFrame, caller: str = "ratio_and_z", blanks: DataFrame | None = None, **params) -> DataFrame:
    return CALLERS.get(caller)(frame, blanks, **params)


def available() -> list[dict]:
    return [{"caller": n, "uses_blank_wells": CALLERS.meta(n)["needs_blanks"]} for n in CALLERS]


def score_calls(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Per (pair, caller): confusion counts, precision, recall, F1. Wells without a truth count as no binders; undefined rates are null, F1 without a true positive is 0."""
    merged = calls.join(truth.select(PAIR, "well", "is_binder"), [PAIR, "well"], "left")
    hit, real = F.col("is_hit"), F.coalesce(F.col("is_binder"), F.lit(False))
    counts = merged.groupBy(PAIR, "caller").agg(*[F.count_if(e).alias(n) for n, e in (("tp", hit & real), ("fp", hit & ~real), ("fn", ~hit & real), ("tn", ~hit & ~real), ("n_binders", real))], F.first("verdict").alias("verdict"))
    rates = counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    return rates.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def evaluate(frame: DataFrame, truth: DataFrame, blanks: DataFrame | None = None, callers: list[str] | None = None, respect_verdict: bool = True, **params) -> DataFrame:
    """Every caller on every pair; a plate that cannot be read has no hits if its verdict is respected."""
    scored = []
    for name in callers or list(CALLERS):
        calls = call(frame, name, blanks, **params)
        if respect_verdict:
            calls = calls.withColumn("is_hit", F.col("is_hit") & (F.col("verdict") != UNCALLABLE))
        scored.append(score_calls(calls, truth))
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def summarise(scored: DataFrame, by: str = "caller") -> DataFrame:
    """Means of the rates (undefined ones skipped), share of refused plates, plates."""
    return scored.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.avg((F.col("verdict") == UNCALLABLE).cast("double")).alias("refused"), F.count("*").alias("plates"))


#: Right-closed bands.
DYNAMIC_BANDS = (0.0, 6.0, 12.0, 30.0, float("inf"))
SATURATION_BANDS = (-0.001, 0.02, 0.10, 0.20, 1.0)


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of the band (low, high] of a value, from 0; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out
