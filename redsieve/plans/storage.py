"""Relations that several steps read are written once, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the folder of spark.checkpoint.dir. Where it's unset, one machine makes a folder of its own; a cluster, whose
    executors wouldn't see that folder, is refused."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="redsieve-"))
    return df.checkpoint()
