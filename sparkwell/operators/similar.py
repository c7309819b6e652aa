"""Pairs of sequences within an edit distance, and the nearest ones, without comparing all with all.

A sequence that is cut into one piece more than there may be edits keeps a piece
whole in every partner, and at nearly the same place. Pieces meet by key; only
sequences that share one are compared, by a distance that stops at the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .storage import checkpointed


def _piece(size: F.Column, i: F.Column, edits: int) -> tuple[F.Column, F.Column]:
    """(start from 0, length) of piece i of a sequence in ``edits + 1`` pieces; the later ones are longer by one."""
    short = F.floor(size / (edits + 1))
    left = edits + 1 - size % (edits + 1)
    return (i * short + F.greatest(F.lit(0), i - left)).cast("int"), (short + (i >= left).cast("int")).cast("int")


def within_edits(rows: DataFrame, edits: int, key: str = "seq_id", sequence: str = "cdr3_aa", group: str | None = None) -> DataFrame:
    """(group, a, b, distance) of the pairs of rows, ``a`` less than ``b``, that are at most so many edits apart; each pair once.

    Pairs are looked for inside a group, if one is named. Sequences should be
    distinct there, as equal ones make a pair each; rows with a null are left out.
    A row sends some ``(edits + 1) ** 3`` pieces at most, whatever the number of
    rows. An empty table has no pairs.
    """
    g = F.lit(0) if group is None else F.col(group)
    own = rows.where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).select(g.alias("g"), F.col(key).alias("id"), F.col(sequence).alias("s"), F.length(sequence).alias("n"))
    pieces = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _piece(F.col("n"), F.col("i"), edits)
    stored = pieces.select("g", F.col("n").alias("m"), "i", F.substr(F.col("s"), start + 1, size).alias("piece"), F.col("id").alias("id2"), F.col("s").alias("s2"))
    # a partner is as long or shorter; its piece may have moved by as much as leaves edits for the rest
    asked = pieces.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - edits), F.col("n"))))
    start, size = _piece(F.col("m"), F.col("i"), edits)
    longer = F.col("n") - F.col("m")
    low, high = F.greatest(F.lit(0), start - F.floor((edits - longer) / 2)).cast("int"), F.least(F.col("n") - size, start + F.floor((edits + longer) / 2)).cast("int")
    asked = asked.withColumns({"low": low, "high": high, "size": size}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    asked = asked.select("g", "m", "i", F.substr(F.col("s"), F.col("at") + 1, F.col("size")).alias("piece"), "id", "s", "n")
    met = asked.join(stored, ["g", "m", "i", "piece"]).where((F.col("n") > F.col("m")) & (F.col("id") != F.col("id2")) | (F.col("id") < F.col("id2")))
    pairs = met.select("g", F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.when(F.col("id") < F.col("id2"), F.col("s")).otherwise(F.col("s2")).alias("x"), F.when(F.col("id") < F.col("id2"), F.col("s2")).otherwise(F.col("s")).alias("y")).distinct()
    told = pairs.withColumn("distance", F.levenshtein("x", "y", edits)).where("distance >= 0")
    out = told.select(*([F.col("g").alias(group)] if group else []), "a", "b", "distance", F.greatest(F.length("x"), F.length("y")).alias("longest"))
    return out


def worst_pairs(picked: DataFrame, group: str | None = None, key: str = "seq_id", sequence: str = "cdr3_aa") -> DataFrame:
    """(group, a, b, identity): the two rows of each group that are most alike, of equal pairs that of the least keys.

    Equal sequences are the most alike there can be. Otherwise the number of edits
    grows until no pair that is farther apart could be more alike than one found.
    Groups of less than two sequences have no row.
    """
    g = F.lit(0) if group is None else F.col(group)
    rows = checkpointed(picked.where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).select(g.alias("g"), F.col(key).alias("id"), F.col(sequence).alias("s")))
    same = rows.groupBy("g", "s").agg(F.slice(F.sort_array(F.collect_set("id")), 1, 2).alias("ids")).where(F.size("ids") > 1)
    best = same.groupBy("g").agg(F.min(F.struct(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"))).alias("p")).select("g", "p.a", "p.b", F.lit(1.0).alias("identity"))
    done = checkpointed(best)
    rest = checkpointed(rows.join(done.select("g"), "g", "left_anti"))
    limits = rest.groupBy("g").agg(F.max(F.length("s")).alias("most"), F.count("*").alias("k")).where("k > 1").select("g", "most")
    edits = 1
    while not (open_ := checkpointed(limits.join(done.select("g"), "g", "left_anti"))).isEmpty():
        longest = open_.agg(F.max("most")).first()[0]
        found = within_edits(rest.join(open_.select("g"), "g", "left_semi"), edits, "id", "s", "g")
        found = found.withColumn("identity", F.round(1 - F.col("distance") / F.col("longest"), 9))
        top = found.groupBy("g").agg(F.min(F.struct((-F.col("identity")).alias("x"), "a", "b")).alias("p")).join(open_, "g")
        # what was not found is more than ``edits`` apart
        sure = F.lit(edits >= longest) | (-F.col("p.x") > F.round(1 - (edits + 1) / F.greatest(F.col("most"), F.lit(1)), 9))
        done = checkpointed(done.unionByName(top.where(sure).select("g", "p.a", "p.b", (-F.col("p.x")).alias("identity"))))
        if edits >= longest:
            break
        edits = min(2 * edits, longest)
    return done.select(*([F.col("g").alias(group)] if group else []), "a", "b", "identity")


def identity_curve(pool: DataFrame, picked: DataFrame, draws: int = 30, seed: int = 42, key: str = "seq_id", sequence: str = "cdr3_aa") -> DataFrame:
    """(draw, identity): the worst identity of the picks, as draw 0, and of so many random sets of as many rows of the pool.

    A set is the rows of least digest with its number, so a draw is repeatable and
    needs no collect; only the first of each part go to the shuffle.
    """
    n = picked.count()
    numbered = pool.select(F.col(key).alias("id"), F.col(sequence).alias("s")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = W.Window.partitionBy("draw").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw"), F.col("id"))), "id")
    drawn = numbered.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    every = drawn.unionByName(picked.select(F.col(key).alias("id"), F.col(sequence).alias("s"), F.lit(0).alias("draw")))
    return worst_pairs(every, "draw", "id", "s").select("draw", "identity")
