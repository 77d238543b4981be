"""Stage boundaries: tables that later steps read several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder all executors share (spark.checkpoint.dir; on one machine a temporary one where that is unset).

    Later stages read it several times, and their expressions don't grow with those before.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chalkline-"))
    return df.checkpoint()
