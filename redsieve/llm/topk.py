"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists, one per dimension.

Queries go in blocks of a fixed number, each broadcast in turn; vectors never move. A task takes its vectors block by block. In a
block, a query reads the list of each dimension from the end where its products are largest, scores every vector it comes across
in full, and stops when the sum of the products at the depth reached can't beat its k-th score, which it keeps from block to block;
a block whose largest and smallest components can't beat it is left out. The k best of each task are merged.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
another dimension aren't compared. Rows with the query's own id aren't its candidates. Equal scores rank by id; a query with
fewer candidates than k gets all. An empty vector has score 0 with other empty vectors. Components and scores beyond a long are the nearest
long. An empty table gives an empty result."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsieve.llm.common import saved

#: Vectors of a block, and queries that are broadcast together (8 bytes a component).
VECTORS = 8192
QUERIES = 16_384
SCALE = 256


def whole_numbers(embedding: str, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: str) -> Column:
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return x.isNotNull() & F.coalesce(~bad, F.lit(False))


def _type(c: np.ndarray, q: np.ndarray) -> type:
    """A type in which every score is exact; the fastest of them."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def threshold_search(ids: np.ndarray, c: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floors: list[int | None] | None = None) -> list[tuple[int, int, int]]:
    """query_id, vec_id, score of the k best of the rows of ``c`` for each row of ``q``. floors: for each query, a score below which
    it needs none."""
    n, d = c.shape
    kind = _type(c, q)
    by_id = np.argsort(ids, kind="stable")
    ids, c = ids[by_id], c[by_id].astype(kind)
    q = q.astype(kind)
    order = np.argsort(c, axis=0, kind="stable")
    values = np.take_along_axis(c, order, axis=0)
    out: list[tuple[int, int, int]] = []
    for qid, x, floor in zip(query_ids.tolist(), q, floors or [None] * len(q), strict=True):
        up, down = np.flatnonzero(x > 0), np.flatnonzero(x < 0)
        if floor is not None and values[n - 1, up] @ x[up] + values[0, down] @ x[down] < floor:
            continue
        seen = ids == qid  # its own rows count as seen and are never scored
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        depth, step = 0, max(8, n // 128)
        while True:
            to = min(n, depth + step)
            new = np.zeros(n, dtype=bool)
            new[order[n - to : n - depth, up].ravel()] = True
            new[order[depth:to, down].ravel()] = True
            if to == n:
                new[:] = True  # dimensions in which the query is 0 have no list
            fresh = np.flatnonzero(new & ~seen)
            seen[fresh] = True
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, c[fresh] @ x])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            depth, step = to, step * 2
            if depth == n or seen.all():
                break
            bound = values[n - depth, up] @ x[up] + values[depth - 1, down] @ x[down]
            if len(rows) == k and bound < scores.min() or floor is not None and bound < floor:
                break
        out += [(qid, int(ids[r]), int(s)) for r, s in zip(rows.tolist(), scores.tolist(), strict=True)]
    return out


def _matrices(t: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension."""
    ids = t["vec_id"].to_numpy()
    lists = t["v"]
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = ids[at], flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), dtype=np.int64)
    return out


def _searched(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each task's vectors for each query. queries: as _matrices() returns them."""
    shared, size = vectors.sparkSession.sparkContext.broadcast(queries), VECTORS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}  # of each query: score, the smaller the worse, and minus the id
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                for d, (ids, c) in _matrices(batch.slice(at, size)).items():
                    if d not in shared.value:
                        continue
                    query_ids, x = shared.value[d]
                    floors = [best[i][0][0] if len(best.get(i, ())) == k else None for i in query_ids.tolist()]
                    for i, j, score in threshold_search(ids, c, query_ids, x, k, floors):
                        held = best.setdefault(i, [])
                        if len(held) < k:
                            heapq.heappush(held, (score, -j))
                        else:
                            heapq.heappushpop(held, (score, -j))
        found = [(i, -j, min(max(score, -(1 << 63)), (1 << 63) - 1)) for i, held in best.items() for score, j in held]
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose vec_id is divisible by ``every``, against all rows."""
    v = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding").alias("v"))
    v = saved(v, "vectors")
    queries = saved(v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # QUERIES of them, about
        best = _searched(v, _matrices(block), k)
        best = best if blocks == 1 else saved(best, "best")
        found = best if found is None else found.union(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id::bigint as query_id, rank::int as rank, vec_id::bigint as vec_id, score from r where rank <= 5
"""
