"""Exact top-k inner-product search with a ball tree in every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldeval.llm.common import written

SCALE = 1024
#: Rows under one tree, rows of a leaf.
SHARD = 8192
LEAF = 64
#: Rows of each task searched first, for a kth score that all shards start from.
SEED_ROWS = 512
#: Numbers in one block of queries, which is what goes to the driver and all tasks at once.
BLOCK_NUMBERS = 1 << 20
_HIT = "query int, vec_id long, score long"


def finite(column: str) -> Column:
    """True where a vector is there and all its components are finite."""
    value = F.col(column)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


class BallTree:
    """Balls around halves of halves of integer vectors; equal vectors are held once."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *vectors.T)) if vectors.shape[1] else np.argsort(ids)
        vectors, ids = vectors[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(ids))
        # Of equal vectors no query returns more than k, and one may be its own.
        self.members = [np.unique(ids[a:b])[: k + 1] for a, b in zip(starts, ends)]
        self.points = vectors[starts]
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.order = np.arange(len(starts))
        self._split(0, len(starts))
        largest = np.abs(self.points).max(initial=0)
        self.exact = self.points if float(largest) ** 2 * max(1, vectors.shape[1]) >= 2**53 else self.points.astype(np.float64)

    def _split(self, low: int, high: int) -> int:
        part = self.points[self.order[low:high]].astype(np.float64)
        node = len(self.nodes)
        centre = part.mean(axis=0)
        self.nodes.append((low, high, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max(initial=0.0)))
        if high - low > LEAF:
            far = part[((part - centre) ** 2).sum(axis=1).argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            ranked = np.argsort(part @ (other - far), kind="stable")
            self.order[low:high] = self.order[low:high][ranked]
            middle = (low + high) // 2
            self.nodes[node] = (low, high, self._split(low, middle), self._split(middle, high))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[Any], k: int) -> None:
        """Improves best[q] = (scores, ids, kth): nodes come by their upper bound, and a
        query ends where that is below its kth score."""
        points = queries.astype(np.float64)
        centres, radii = np.array(self.centres), np.array(self.radii)
        length = np.sqrt((points**2).sum(axis=1))[:, None]
        reach = np.sqrt((centres**2).sum(axis=1)) + radii
        bounds = points @ centres.T + length * radii + 1e-9 * length * reach + 1e-6
        exact = queries.astype(self.exact.dtype)
        for q, bound in enumerate(bounds.tolist()):
            scores, ids, kth = best[q]
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= kth:
                low, high, left, right = self.nodes[heapq.heappop(heap)[1]]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                at = self.order[low:high]
                found = (self.exact[at] @ exact[q]).astype(np.int64)
                good = found >= kth if kth > -np.inf else np.ones(len(at), bool)
                if not good.any():
                    continue
                lists = [self.members[i] for i in at[good]]
                more = np.concatenate(lists)
                value = np.repeat(found[good], [len(x) for x in lists])
                other = more != own[q]
                scores, ids = np.concatenate([scores, value[other]]), np.concatenate([ids, more[other]])
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
                if len(top) == k:
                    kth = max(kth, int(scores[-1]))
            best[q] = (scores, ids, kth)


def _search(vectors: DataFrame, block: Any, k: int, floors: Any, rows_each: int | None) -> DataFrame:
    """Hits of a block of queries in every task's rows, or in its first rows only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = block.value
        none = np.empty(0, np.int64)
        best = [(none, none, floor) for floor in floors.value]
        held: list[pa.RecordBatch] = []

        def use() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            data = matrix(table.column(1).chunk(0))
            tree = BallTree(np.floor(SCALE * data).astype(np.int64), table.column(0).to_numpy(), k)
            tree.search(queries, own, best, k)
            held.clear()

        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_each or SHARD):
                part = batch.slice(at, rows_each or SHARD)
                held.append(part)
                seen += part.num_rows
                if sum(x.num_rows for x in held) >= (rows_each or SHARD):
                    use()
                if rows_each and seen >= rows_each:
                    break
            if rows_each and seen >= rows_each:
                break
        if held:
            use()
        counts = [len(ids) for _, ids, _ in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best)), counts), pa.int32()),
                pa.array(np.concatenate([ids for _, ids, _ in best]) if best else none, pa.int64()),
                pa.array(np.concatenate([scores for scores, _, _ in best]) if best else none, pa.int64()),
            ],
            ["query", "vec_id", "score"],
        )

    return vectors.select("vec_id", "embedding").mapInArrow(rows, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to smaller vec_id.

    A vector's components x become floor(SCALE * x); the score is the inner product of those
    whole numbers, over rows of the query's own length of vector but not of its own vec_id.
    Queries go in blocks of BLOCK_NUMBERS components against all rows. First a few rows of
    every task give each query a kth score, then every shard starts from it and passes its
    own on to the next in its task. Null ids, null vectors and those with null or non-finite
    components take no part; rows alike in id and vector count once. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & finite("embedding"))
    queries = written(sound.where(is_query).distinct().withColumn("length", F.size("embedding")), "queries")
    results = []
    for length, number in sorted(map(tuple, queries.groupBy("length").count().collect())):
        mine = queries.where(F.col("length") == length)
        same = sound.where(F.size("embedding") == length)
        blocks = -(-number * max(1, length) // BLOCK_NUMBERS)
        for b in range(blocks):
            part = mine.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).orderBy("vec_id", "embedding").collect()
            if not part:
                continue
            own = np.array([row["vec_id"] for row in part])
            data = np.array([row["embedding"] for row in part], np.float64).reshape(len(part), length)
            block = spark.sparkContext.broadcast((own, np.floor(SCALE * data).astype(np.int64)))
            floors = [-np.inf] * len(part)
            nothing = spark.sparkContext.broadcast(floors)
            first = _ranked(_search(same, block, k, nothing, SEED_ROWS), k).where(F.col("rank") == k)
            for query, score in first.select("query", "score").collect():
                floors[query] = score
            hits = _ranked(_search(same, block, k, spark.sparkContext.broadcast(floors), None), k)
            names = spark.createDataFrame(list(enumerate(own.tolist())), "query int, query_id long")
            named = hits.join(F.broadcast(names), "query")
            results.append(written(named.select("query_id", "rank", "vec_id", "score"), "hits"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


#: DuckDB: every query against every row.
TOP_K_SQL = f"""
WITH sound AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM sound
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
