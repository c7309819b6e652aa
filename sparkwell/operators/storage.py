"""Cutting lineage in iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only by a local session that names no shared folder (as in tests).
LOCAL = "/tmp/checkpoints/sparkwell"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame stored in the session's checkpoint folder, so that a lost executor costs no earlier round."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(LOCAL)
    return df.checkpoint()
