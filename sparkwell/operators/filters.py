"""Repertoire filters: a declared sequence of named steps, applied at once or explained as a funnel."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass(frozen=True)
class Filter:
    """What to keep. A field that is None, or False, is no step; steps on columns that are absent keep everything."""

    genes: tuple[str, ...] | None = None
    families: tuple[str, ...] | None = None
    chain: str | None = None
    cdr3_len_range: tuple[int, int] | None = None
    min_redundancy: int | None = None
    exclude_liabilities: bool = True
    productive_only: bool = True
    drop_duplicate_cdr3: bool = False
    max_ambiguous: int | None = 0

    def as_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def steps(self, columns: list[str]) -> list[tuple[str, Column]]:
        """(name, predicate) in the order in which they are applied; all but the last step on distinct loops."""
        has = set(columns).__contains__
        out: list[tuple[str, Column]] = []
        if self.productive_only and has("productive"):
            word = F.upper(F.trim(F.col("productive").cast("string")))
            # what is not known to be unproductive stays
            out.append(("productive", F.coalesce(word.isin("NAN", "NONE", "", "T", "TRUE", "YES", "1"), F.lit(True))))
        if self.chain:
            out.append((f"chain == {self.chain}", F.coalesce(F.col("chain") == self.chain, F.lit(False))))
        if self.genes:
            out.append((f"v_gene in {len(self.genes)} panel genes", F.coalesce(F.col("v_gene").isin(*self.genes), F.lit(False))))
        if self.families:
            out.append((f"v_family in {list(self.families)}", F.coalesce(F.col("v_family").isin(*self.families), F.lit(False))))
        if self.cdr3_len_range:
            low, high = self.cdr3_len_range
            out.append((f"cdr3_len {low}-{high}", F.coalesce(F.col("cdr3_len").between(low, high), F.lit(False))))
        if self.min_redundancy is not None and has("redundancy"):
            out.append((f"redundancy >= {self.min_redundancy}", F.coalesce(F.col("redundancy"), F.lit(1)) >= self.min_redundancy))
        if self.exclude_liabilities and has("has_liability"):
            out.append(("no liability", ~F.coalesce(F.col("has_liability"), F.lit(False))))
        if self.max_ambiguous is not None and has("n_ambiguous"):
            out.append((f"ambiguous residues <= {self.max_ambiguous}", F.coalesce(F.col("n_ambiguous"), F.lit(0)) <= self.max_ambiguous))
        return out

    def apply(self, rows: DataFrame, tie: str = "seq_id") -> DataFrame:
        """All steps as one predicate. Of equal CDR3s the row with the least ``tie`` stays, found by a keyed aggregation."""
        predicates = [p for _, p in self.steps(rows.columns)]
        kept = rows.where(reduce(lambda a, b: a & b, predicates)) if predicates else rows
        if not self.drop_duplicate_cdr3:
            return kept
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        return kept.groupBy("cdr3_aa").agg(F.min_by(whole, F.col(tie)).alias("_row")).select("_row.*")

    def explain(self, rows: DataFrame) -> DataFrame:
        """(place, step, rows, dropped): what every step leaves, in one pass over the input."""
        named = self.steps(rows.columns)
        passed, sums = F.lit(True), [F.count("*").alias("s0")]
        for i, (_, predicate) in enumerate(named, 1):
            passed = passed & predicate
            sums.append(F.count_if(passed).alias(f"s{i}"))
        names = ["input", *(n for n, _ in named)]
        if self.drop_duplicate_cdr3:
            sums.append((F.count_distinct(F.when(passed, F.col("cdr3_aa"))) + F.max(F.when(passed & F.col("cdr3_aa").isNull(), 1).otherwise(0))).alias(f"s{len(names)}"))
            names.append("unique cdr3")
        lines = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("step"), F.col(f"s{i}").cast("long").alias("rows"), F.coalesce(F.col(f"s{max(0, i - 1)}") - F.col(f"s{i}"), F.lit(0)).cast("long").alias("dropped")) for i, n in enumerate(names)])
        return rows.agg(*sums).select(F.inline(lines))


def drop_duplicates_keeping(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``."""
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
