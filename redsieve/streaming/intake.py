"""Documents that arrive as files, through the batch functions; an addition of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Parquet files that arrive under ``path``, a few a batch."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files).parquet(path)


def start_intake(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch through ``step`` into a folder of its own, which a batch that is run again overwrites: each is there once."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
