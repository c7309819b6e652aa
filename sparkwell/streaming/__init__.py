"""Structured Streaming: incremental ingest of repertoire files, and windowed counts of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.filters import Filter
from ..operators.pool import append_new, normalize
from ..operators.store import exists
from ..sources.binary import read_traces


def pool_stream(spark: SparkSession, folder: str, schema: T.StructType, meta: dict[str, str], source_ref: str, keep: Filter | None = None) -> DataFrame:
    """Normalised, filtered rows of Parquet files as they arrive."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return (keep or Filter()).apply(normalize(raw, meta, source_ref))


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of traces as their files arrive; Spark's own file stream keeps the log of the files that it has read."""
    return read_traces(spark, folder, streaming=True)


def append_to_pool(stream: DataFrame, pool: str, checkpoint: str) -> DataStreamWriter:
    """Appends rows whose id the pool has not, batch by batch.

    A batch is written under its own number, so that a batch which is run again
    after a failure replaces what it wrote before, and is compared with the other
    batches only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, pool):
            stored = spark.read.option("basePath", pool).parquet(pool).where(F.col("batch") != number).select("seq_id")
        else:  # before the first batch
            stored = spark.createDataFrame([], "seq_id string")
        append_new(stored, batch).write.mode("overwrite").parquet(f"{pool}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def counts_by_window(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value for each kind and tumbling window; later events than ``late`` are left out in a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("window_start"), kind, "n", "mean_value")
