"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number from a hash; the shard with the
largest ``-weight / ln(u)`` takes the record. A further shard competes for each
record but changes no other pair, so that it takes records only into itself, in
proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, materialize, numbered

_TWO_53 = float(2**53)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 42) -> Column:
    """Number of the shard that takes ``key``: built-in functions only.

    A null key is a key of its own. Weights must be positive. Ties of score,
    possible only when two hashes agree in 53 bits, go to the larger number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and positive weights, are needed")
    bids = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), F.coalesce(key.cast("string"), F.lit("\0null"))), 11)
        uniform = (bits.cast("double") + 0.5) / _TWO_53
        bids.append(F.struct((-F.lit(float(weight)) / F.ln(uniform)).alias("bid"), F.lit(shard).alias("shard")))
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Shard, gapless slot inside the shard, and the shard after one more of ``grown_weight`` joins.

    Columns: the key, ``size`` (UTF-8 bytes of the text plus 8; null counts as
    empty), ``text_crc32``, ``law`` (``key``), ``shard``, ``slot``,
    ``grown_shard``. Only the narrow rows are shuffled, once, dealt by shard and
    a hash of the key and the row's place, so neither a shard's rows nor those of
    one repeated or null key meet in one task. Repeated rows get the same shard
    and slots of their own; an empty table gives none; other columns, also of
    these names, are ignored.
    """
    body = clean_text(text)
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), list(weights)).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    stored = materialize(narrow, "shards")
    out = numbered(stored, "shard", [key, "_row"], stored.count(), "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
