"""Which plate a sheet shows: explicit, by barcode, by name, by keyword or by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Precedence and confidence of the sources of an assignment.
PRECEDENCE = {"explicit": 1, "barcode": 2, "name": 3, "model": 4, "unresolved": 5}
CONFIDENCE = {"explicit": 1.0, "barcode": 0.99, "name": 0.8, "keyword": 0.75}
#: Words by which a sheet says what it shows.
TARGET_WORDS = ("target", "antigen", "experimental", "test", "expt")
CONTROL_WORDS = ("control", "ctrl", "hla", "irrelevant", "negative", "neg")
#: Known barcodes or names with which every text is compared; beyond, words are looked up by their first characters.
MAX_NAMES = 1000
#: First characters by which a word is looked up.
GRAM = 4


def mentions(grids: DataFrame, words: DataFrame) -> DataFrame:
    """(grid_id, word, plate_id): which of ``words`` (word, plate_id) stand anywhere in a grid's text, whatever the case.

    Few words are broadcast and compared. Of many, only those are compared with a
    text that share their first characters with one of its stretches, found by
    key; a text moves once. Blank words stand nowhere. The result is the same.
    """
    known = words.where("word <> ''").select("word", "plate_id", F.lower("word").alias("_w")).distinct()
    texts = grids.select("grid_id", F.lower("text").alias("_t"))
    if known.limit(MAX_NAMES + 1).count() <= MAX_NAMES:
        return texts.join(F.broadcast(known), F.contains("_t", "_w")).select("grid_id", "word", "plate_id")
    keyed = known.withColumn("_g", F.substring("_w", 1, GRAM)).withColumn("_n", F.length("_g"))
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    stretches = F.transform(sizes, lambda n: F.when(F.length("_t") >= n, F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda i: F.substr(F.col("_t"), i, n))))
    grams = texts.select("grid_id", F.explode(F.array_distinct(F.flatten(F.filter(stretches, lambda x: x.isNotNull())))).alias("_g"))
    likely = grams.join(keyed, "_g").groupBy("grid_id").agg(F.collect_list(F.struct("_w", "word", "plate_id")).alias("_c"))
    both = texts.join(likely, "grid_id")
    return both.select("grid_id", F.explode(F.filter("_c", lambda c: F.contains(F.col("_t"), c["_w"]))).alias("c")).select("grid_id", "c.word", "c.plate_id")


def by_barcode(grids: DataFrame, barcodes: DataFrame) -> DataFrame:
    """(grid_id, source, plate_id, confidence, alternatives): barcodes that stand anywhere in a grid's text; more than one, or one that is on several plates, is unresolved."""
    hits = mentions(grids, barcodes.select(F.col("barcode").alias("word"), "plate_id"))
    found = hits.groupBy("grid_id").agg(F.count_distinct("word").alias("_n"), F.min("plate_id").alias("plate_id"), F.sort_array(F.collect_set("plate_id")).alias("alternatives"))
    one = (F.col("_n") == 1) & (F.size("alternatives") == 1)
    return found.select("grid_id", F.when(one, "barcode").otherwise("unresolved").alias("source"), F.when(one, F.col("plate_id")).alias("plate_id"), F.when(one, F.lit(CONFIDENCE["barcode"])).otherwise(0.0).alias("confidence"), F.when(one, F.array().cast("array<string>")).otherwise(F.col("alternatives")).alias("alternatives"))


def by_name(grids: DataFrame, names: DataFrame) -> DataFrame:
    """Names of more than three characters that stand in a grid's text, if exactly one does."""
    hits = mentions(grids, names.where(F.length("name") > 3).select(F.col("name").alias("word"), "plate_id"))
    one = hits.groupBy("grid_id").agg(F.count_distinct("word").alias("_n"), F.min("plate_id").alias("plate_id")).where("_n = 1")
    return one.select("grid_id", F.lit("name").alias("source"), "plate_id", F.lit(CONFIDENCE["name"]).alias("confidence"), F.array().cast("array<string>").alias("alternatives"))


def kind_from_text(grids: DataFrame) -> DataFrame:
    """(grid_id, plate_kind): target or control by keyword, if the text speaks of one only."""
    low = F.lower("text")
    target, control = (low.rlike("|".join(words)) for words in (TARGET_WORDS, CONTROL_WORDS))
    return grids.select("grid_id", F.when(target & ~control, "target").when(control & ~target, "control").alias("plate_kind"))


def propose(grids: DataFrame, barcodes: DataFrame, names: DataFrame, explicit: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """One row for each grid: the plate by the source of highest precedence; its kind by the first source that has one.

    ``explicit`` and ``model`` have (grid_id, plate_id, plate_kind, confidence).
    """
    fields = ["grid_id", "source", "plate_id", "confidence", "plate_kind"]
    kinds = kind_from_text(grids)
    found = [f.withColumn("plate_kind", F.lit(None).cast("string")).select(*fields) for f in (by_barcode(grids, barcodes), by_name(grids, names))]
    for frame, source in ((explicit, "explicit"), (model, "model")):
        if frame is not None:
            found.append(frame.withColumn("source", F.lit(source)).select(*fields))
    found.append(grids.select("grid_id", F.lit("unresolved").alias("source"), F.lit(None).cast("string").alias("plate_id"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("plate_kind")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    place = F.create_map(*[F.lit(x) for p in PRECEDENCE.items() for x in p])[F.col("source")]
    # a source of lower precedence never changes a plate but may give a kind that is missing
    best = every.groupBy("grid_id").agg(F.min_by(F.struct("source", "plate_id", "confidence"), place).alias("b"), F.min_by("plate_kind", F.when(F.col("plate_kind").isNotNull(), place)).alias("_kind"))
    return best.join(kinds, "grid_id", "left").select("grid_id", "b.source", "b.plate_id", "b.confidence", F.coalesce("_kind", "plate_kind").alias("plate_kind"))


def unresolved(assignments: DataFrame) -> DataFrame:
    """What a human must look at."""
    return assignments.where(F.col("source").isin("model", "unresolved"))


def pair_up(assignments: DataFrame) -> DataFrame:
    """Consecutive grids as pairs: (pair, first, second) by ``place`` from 0; the last of an odd number has no second."""
    return assignments.groupBy(F.floor(F.col("place") / 2).alias("pair")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("grid_id"))).alias("first"), F.max(F.when(F.col("place") % 2 == 1, F.col("grid_id"))).alias("second"))


def report(assignments: DataFrame) -> DataFrame:
    """(source, grids, confirmed, least_confidence): how many grids each source settled, and how sure it is; ``confirmed`` need no human."""
    return assignments.groupBy("source").agg(F.count("*").alias("grids"), F.count_if(~F.col("source").isin("model", "unresolved")).alias("confirmed"), F.min("confidence").alias("least_confidence"))
