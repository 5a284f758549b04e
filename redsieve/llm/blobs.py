"""Binary files through Spark's own writers and readers: one file a row, committed as any table is.

Executors reach the shared folder only by Spark, so a file's bytes go through the text writer (which writes a string's bytes
as they are and ends each file with a separator) and come back through the binary reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(rows: DataFrame, column: str, path: str, end: bytes = b"\n") -> None:
    """Each row's bytes as a file of its own under ``path``, followed by ``end``, which can't be empty."""
    options = {"maxRecordsPerFile": 1, "compression": "none", "encoding": "ISO-8859-1", "lineSep": end.decode("latin-1")}  # the encoding is that of lineSep alone
    rows.select(F.col(column).cast("string").alias("value")).write.options(**options).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """content: the bytes of each file as they are, with its end."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
