"""Shared pieces: expressions over words, small tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
_SPACE_RUN = "[ \\t-\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row instead of once a use."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACES, in order."""
    return F.filter(F.split(text, _SPACE_RUN), lambda w: w != "")


def removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(removed(text, characters))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where it's unset, one machine makes a folder of its
    own; a cluster, whose executors wouldn't see that folder, is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="redsieve-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/redsieve/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a cut of the lineage that outlives any executor.
    files: for tables of a row per group, so that the planner sees how small they are."""
    df = df if files is None else df.repartition(files)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that may be broadcast to pick documents; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def bounded(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``ids``, a written table, to be broadcast where its rows are counted to be few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def row_key(*columns: str) -> list[Column]:
    """_k1, _k2: 128 bits that tell rows apart by these columns, nulls included. Rows that are alike in them share the key."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts).alias("_k2")]


KEY = ("_k1", "_k2")


def without(docs: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """``docs`` in their own columns, less the rows whose row_key() of ``columns`` is in ``gone``."""
    gone = saved(gone.select(*KEY).distinct(), "gone")
    k1, k2 = (fresh(docs, k) for k in KEY)
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(*columns), strict=True)))
    gone = bounded(gone.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2)))
    return keyed.join(gone, [k1, k2], "left_anti").select(*docs.columns)


def thinned(docs: DataFrame, again: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with one row left of those that share a row_key() of ``columns`` which is in ``again``, a written table."""
    if again.isEmpty():
        return docs
    k1, k2 = (fresh(docs, k) for k in KEY)
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(*columns), strict=True)))
    again = bounded(again.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2)))
    one = keyed.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return keyed.join(again, [k1, k2], "left_anti").unionByName(one).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
