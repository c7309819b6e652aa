"""Parallelism for expensive expressions over few input partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows and so many bytes of its texts; beyond, both sides are shuffled.
MAX_ROWS, MAX_BYTES = 1_000_000, 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows round-robin if the scan has fewer partitions than the cluster has cores.

    A file of one row group is one task, however long its rows take. On inputs of
    many files this does nothing; it never merges partitions.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def broadcast_within(rows: DataFrame, *texts: str) -> DataFrame:
    """Broadcast hint for a side whose rows, and bytes in ``texts``, were counted; otherwise the side as it is."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    n, most = rows.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(rows) if n <= MAX_ROWS and (most or 0) <= MAX_BYTES else rows


def sliced(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and so many bytes or items in texts and lists unless one row has more: a helper that makes objects of rows holds only a part."""
    held = np.zeros(len(batch), np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            held += pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    total = np.r_[0, np.cumsum(held)]
    at = 0
    while at < len(batch):
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end
