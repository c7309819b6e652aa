"""Sequencing order forms from samples (well, sample_name)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import wells
from ..registry import Registry

FORMS: Registry[Callable[..., DataFrame]] = Registry("order form")
#: Most samples of a form, and vocabularies.
MOST = {"genewiz": 500, "elim": 96, "ucberkeley": 95}
TEMPLATE_TYPES = ("Plasmid", "PCR Product", "BAC DNA", "Genomic DNA", "Cosmid", "Other (e.g. Bacteria)")
PREMIX = ("Premix", "Non-Premix")


def _clean(samples: DataFrame) -> DataFrame:
    name = F.col("sample_name") if "sample_name" in samples.columns else F.col("clone_id")
    return samples.withColumns({"well": wells.normalize(F.col("well"), 96, strict=True), "sample_name": name.cast("string")})


def _optional(samples: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in samples.columns else F.lit(default)


def _in_order(samples: DataFrame, key: Column) -> Column:
    return F.row_number().over(W.Window.partitionBy().orderBy(key, "sample_name"))  # one plate


@FORMS.register("genewiz", confidence="verified")
def genewiz(samples: DataFrame, primer: str = "") -> DataFrame:
    """Rows pair the i-th well across with the i-th well down; samples run down the plate."""
    data = _clean(samples)
    n = _in_order(data, wells.column_major(F.col("well")))
    rows = data.withColumn("n", n)
    return rows.select(wells.at_row_major(F.col("n")).alias("Well (H)"), wells.at_column_major(F.col("n")).alias("Well (V)"), F.col("n").cast("long").alias("Sample #"), F.col("sample_name").alias("DNA Name"), _optional(rows, "length_bp").alias("Length (bp)"), _optional(rows, "concentration_ng_ul").alias("Concentration (ng/uL)"), _optional(rows, "primer", primer).alias("Primer"), _optional(rows, "difficult").alias("Difficult Template"), _optional(rows, "notes").alias("Notes"), F.lit("").alias("Is Empty"))


@FORMS.register("elim", confidence="verified")
def elim(samples: DataFrame, primer: str = "", template_type: str = "Plasmid", premix: str = "Premix") -> DataFrame:
    """Wells along the rows, written A1."""
    data = _clean(samples)
    rows = data.withColumn("n", _in_order(data, wells.row_major(F.col("well"))))
    return rows.select(F.col("n").cast("long").alias("Reaction #"), wells.short(F.col("well")).alias("Well"), F.col("sample_name").alias("Template Name*"), F.lit(template_type).alias("Template Type"), _optional(rows, "concentration_ng_ul").alias("Template Conc (ng/ul)"), _optional(rows, "length_bp").alias("Template Size (bp)*"), _optional(rows, "primer", primer).alias("Primer Name*"), _optional(rows, "primer_um").alias("Primer Conc (uM)"), F.lit(premix).alias("Premix?*"), _optional(rows, "anneal_c").alias("Preferred Annealling Temp. (oC)"), _optional(rows, "gc_rich", "No").alias("GC Rich?"), _optional(rows, "notes").alias("Notes"))


@FORMS.register("ucberkeley", confidence="verified")
def ucberkeley(samples: DataFrame, primer: str = "") -> DataFrame:
    """Two blocks side by side, columns 1-6 and 7-12, each running down; every well is listed."""
    data = _clean(samples)
    last = data.groupBy("well").agg(F.max("sample_name").alias("name"))
    plate = wells.all_wells(data.sparkSession, 96).join(F.broadcast(last), "well", "left").select("place_down", wells.short(F.col("well")).alias("w"), F.coalesce("name", F.lit("")).alias("name"))
    block = lambda low, suffix: plate.where(F.col("place_down").between(low, low + 47)).select((F.col("place_down") - low).alias("k"), F.col("w").alias(f"well #{suffix}"), F.col("name").alias(f"SAMPLE NAME{suffix}"), F.lit("").alias(f"SPECIAL INSTRUCTION{suffix}"))
    return block(1, "").join(block(49, " (7-12)"), "k").drop("k")


@FORMS.register("generic", confidence="verified")
def generic(samples: DataFrame, primer: str = "") -> DataFrame:
    data = _clean(samples)
    return data.select("well", "sample_name", _optional(data, "primer", primer).alias("primer"), _optional(data, "length_bp").alias("length_bp"), _optional(data, "concentration_ng_ul").alias("concentration_ng_ul"), _optional(data, "clone_id").alias("clone_id"))


def issues(samples: DataFrame, form: str, template_type: str = "Plasmid", premix: str = "Premix") -> DataFrame:
    """(issue, n): what a form would reject."""
    data = _clean(samples)
    n = F.count("*")
    cases: list[tuple[str, Column]] = []
    if form in MOST:
        cases.append((f"more than {MOST[form]} samples", F.greatest(F.lit(0), n - MOST[form])))
    if form == "elim":
        cases += [("names over 50 characters", F.count_if(F.length("sample_name") > 50)), ("names with other characters than letters, digits, _ and -", F.count_if(~F.col("sample_name").rlike("^[A-Za-z0-9_-]+$")))]
        cases += [(f"unknown {k}: {v}", F.lit(1)) for k, v, known in (("template type", template_type, TEMPLATE_TYPES), ("premix", premix, PREMIX)) if v not in known]
    if form == "genewiz":
        ranked = data.withColumn("_n", _in_order(data, wells.column_major(F.col("well"))))
        data = ranked.withColumn("_off", F.col("well") != wells.at_column_major(F.col("_n")))
        cases.append(("samples are not contiguous down the plate", F.count_if(F.col("_off"))))
    if not cases:
        return data.sparkSession.createDataFrame([], "issue string, n long")
    sums = data.agg(*[c.cast("long").alias(f"c{i}") for i, (_, c) in enumerate(cases)])
    lines = F.array(*[F.struct(F.lit(m).alias("issue"), F.col(f"c{i}").alias("n")) for i, (m, _) in enumerate(cases)])
    return sums.select(F.inline(lines)).where("n > 0")


def order(samples: DataFrame, form: str, allow_issues: bool = False, **options) -> DataFrame:
    """The filled form; refused if it has issues."""
    handler = FORMS.get(form)
    found = issues(samples, form, **{k: v for k, v in options.items() if k in ("template_type", "premix")})
    if not allow_issues and (told := found.limit(20).collect()):
        raise ValueError("; ".join(f"{r['issue']} ({r['n']})" for r in told))
    return handler(samples, **{k: v for k, v in options.items() if k == "primer" or form == "elim"})


def available() -> list[dict]:
    return [{"form": n, **FORMS.meta(n)} for n in FORMS]

