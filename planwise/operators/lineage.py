"""Where a plan is cut: tables that are read several times are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, which any executor can read; in a local folder only for a local master."""
    if getattr(df, "_planwise_cut", False):
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="planwise-"))
    out = df.checkpoint()
    out._planwise_cut = True
    return out
