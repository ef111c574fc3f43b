"""Cutting the lineage of a DataFrame in a folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to and read from the folder in ``spark.checkpoint.dir``; on one machine a temporary one if unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="trackspark-"))
    return df.checkpoint()
