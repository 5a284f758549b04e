"""Best-fit packing over three capacities: tokens, documents and attention cost (the sum of squared lengths).

Lengths are whole numbers up to the token capacity, so the corpus is packed by its histogram of lengths, however large it is:
bins in one state are one group with a range of sequence numbers, and a step puts pieces of one length into all bins of the group
that fits best. From the long to the short, each piece goes to the feasible group whose residual vector after it has the least
weighted norm (or whose residual has the largest weighted dot product with the piece's vector). What comes out is a table of
runs, whose size depends on the capacity and not on the number of documents; the rank of a piece among those of its length finds
its run. Ranks come from counts by length and bucket of row numbers, so a length that a third of all pieces have is ranked in parts.

Defined results: a null or empty text is the end id alone, one piece of length 1. Rows that repeat a doc_id are packed each on its
own, and so are rows with a null doc_id. Texts longer than a sequence are cut into whole sequences, of which the first may be
shorter. An empty table gives an empty one."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redsieve.llm.common import saved, text_of
from redsieve.llm.ids import encoder, slices

#: What the residuals of tokens, documents and cost, as parts of their capacities, count in a sequence's choice.
WEIGHTS = (1.0, 1.0, 1.0)
#: Pieces that are ranked together at most, about.
BUCKET = 50_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the ids of each text and the end id, cut at ``capacity``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            kinds = (batch["doc_id"].type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            for part in slices(batch):
                rows: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), of.encode(part["_t"].to_pylist()), strict=True):
                    data = ids + end
                    n = len(data) // 4
                    start, piece = 0, 0
                    stop = n % capacity or min(n, capacity)
                    while start < n:
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("_t")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_runs(counts: dict[int, int], capacities: tuple[int, int, int], rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Rows of length, first rank, number, first sequence, offset: ``number`` pieces of that length, from that rank on, go to as
    many sequences from that one on, at that offset. Each of capacities (tokens, documents, cost) holds in every sequence."""
    cap = np.array(capacities, dtype=np.int64)
    w = np.array(weights)
    size = 64
    left = np.zeros((size, 3), dtype=np.int64)  # residual capacities of a group's bins
    first, many = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    groups, sequences, runs = 0, 0, []

    def add(residual: np.ndarray, at: int, n: int) -> None:
        nonlocal groups, left, first, many
        if groups == len(many):
            left, first, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([first, np.zeros_like(first)]), np.concatenate([many, np.zeros_like(many)])
        left[groups], first[groups], many[groups] = residual, at, n
        groups += 1

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity of {capacities}")
        while todo:
            fits = np.flatnonzero((left[:groups] >= item).all(axis=1) & (many[:groups] > 0))
            if not len(fits):
                most = int((cap // item).min())  # pieces of this length that a bin holds
                add(cap, sequences, n := -(-todo // most))
                sequences += n
                continue
            if rule == "norm":
                best = fits[np.argmin(((left[fits] - item) / cap * w) ** 2 @ np.ones(3))]
            else:
                best = fits[np.argmax((left[fits] / cap * w) @ (item / cap))]
            n = min(todo, int(many[best]))
            runs.append((length, rank, n, int(first[best]), int(cap[0] - left[best, 0])))
            if n < many[best]:
                add(left[best].copy(), int(first[best]) + n, int(many[best]) - n)
            left[best] -= item
            many[best] = n
            todo, rank = todo - n, rank + n
        # bins that hold no piece of the least length any more are settled
        if groups > 256:
            open_ = (left[:groups, 0] > 0) & (left[:groups, 1] > 0) & (left[:groups, 2] > 0)
            k = int(open_.sum())
            left[:k], first[:k], many[:k] = left[:groups][open_], first[:groups][open_], many[:groups][open_]
            groups = k
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_rank``, the place of each among the rows of its length, from 0. _id: a number of the row, written with it."""
    buckets = max(1, rows.count() // BUCKET)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(counts.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_id"))
    return rows.withColumn("_within", within).join(offsets, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1).drop("_b", "_within", "_before")


def place(rows: DataFrame, capacities: tuple[int, int, int], rule: str = "norm") -> DataFrame:
    """``rows``, which have a ``length`` and a number ``_id`` and are a written table, with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    runs = plan_runs(counts, capacities, rule)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = rows.sparkSession.sparkContext.broadcast(runs[order])  # depends on the capacity, not on the number of rows

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = shared.value
        width = int(run[:, 1].max()) + 1 if len(run) else 1
        starts = run[:, 0].astype(object) * width + run[:, 1]
        starts = starts.astype(np.int64) if not len(run) or int(run[:, 0].max()) * width < 2**62 else starts
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            keys = length * width + np.minimum(rank, width - 1) if starts.dtype != object else length.astype(object) * width + np.minimum(rank, width - 1)
            at = np.searchsorted(starts, keys, side="right") - 1
            found = [pa.array(run[at, 3] + rank - run[at, 1]), pa.array(run[at, 4])]
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in keep], *found], [*keep, "sequence_id", "offset"])

    names = [c for c in rows.columns if c != "_id"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return _ranked(rows).select(*names, "_rank").mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, tokens: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece. documents and cost: capacities of a sequence,
    by default what the token capacity allows anyway, so that sequences are as few as best fit makes them."""
    capacities = (tokens, documents or tokens, cost or tokens * tokens)
    numbered = pieces(docs, vocabulary, end_id, tokens).withColumn("_id", F.monotonically_increasing_id())
    return place(saved(numbered, "pieces"), capacities, rule)
