"""Connected components of an undirected graph of ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of the node and its neighbours."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is hung on the least of them. ``e`` has a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    return e.join(least, "b").select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


#: Edges that one task may take, a few bytes each; more are dealt to as many tasks as a shuffle has.
FEW = 50_000


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) for each id with an edge. edges: a and b, longs; loops, nulls and
    repeated edges do no harm. Each round is written to the shared folder; nothing but a count and a checksum is collected. Few edges, counted, are left in
    one task."""
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    few = e.count() <= FEW
    last = None
    while True:
        e = e.repartition(1) if few else e  # then no step below has to shuffle
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
        stars = _large_star(e)
        e = saved(_small_star(stars if few else saved(stars, "stars")), "edges")
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select(F.col("a"), F.col("a")).distinct())
