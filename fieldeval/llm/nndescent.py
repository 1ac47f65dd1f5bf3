"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldeval.llm.common import written
from fieldeval.llm.topk import finite, matrix

#: Neighbours of a node, and how many nodes that point to it take part in its local join.
DEGREE = 20
REVERSE = 20
#: Rows compared with each other for the first graph, and for how many orders of all nodes
#: that is done each time the number of nodes doubles.
START_ROWS = 2048
ORDERS = 4
#: Rounds end when fewer than this share of edges is new.
FEW_NEW = 0.001
#: Nodes that a query keeps while it searches.
BEAM = 100
_EDGE = "node long, near long, sim double"


def _placed_rows(batches: Iterator[pa.RecordBatch], normals: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each node once for every order, with the sides it is on of that order's planes as a code."""
    orders, planes = offsets.shape
    values = 1 << np.arange(planes, dtype=np.int64)[::-1]
    for batch in batches:
        if not batch.num_rows:
            continue
        data = matrix(batch.column(1))
        for k in range(orders):
            code = (data @ normals[k].T > offsets[k]) @ values if planes else np.zeros(len(data), np.int64)
            columns = [pa.array(np.full(len(data), k, np.int32)), pa.array(code), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["order_no", "code", "node", "embedding"])


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of each node among about START_ROWS nodes beside it in an order."""
    for batch in batches:
        order = batch.column(0).to_numpy()
        for run in np.split(np.arange(batch.num_rows), np.flatnonzero(order[1:] != order[:-1]) + 1):
            for part in np.array_split(run, max(1, -(-len(run) // START_ROWS))):
                if len(part) < 2:
                    continue
                ids = batch.column(2).to_numpy()[part]
                data = matrix(batch.column(3).slice(int(part[0]), len(part)))
                sims = data @ data.T
                np.fill_diagonal(sims, -np.inf)
                k = min(DEGREE, len(part) - 1)
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(part)), k)
                yield _edges(ids[rows], ids[top.ravel()], sims[rows, top.ravel()])


def _edges(node: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(sim, pa.float64())], ["node", "near", "sim"]
    )


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (hub, node, fresh, least, embedding) sorted by hub: neighbours of a hub that
    are nearer to each other than the farthest neighbour that one of them has."""
    for table in _by_hub(batches):
        hub = table.column(0).to_numpy()
        node = table.column(1).to_numpy()
        fresh = table.column(2).to_numpy(zero_copy_only=False)
        least = table.column(3).to_numpy()
        data = matrix(table.column(4).combine_chunks())
        ends = np.flatnonzero(hub[1:] != hub[:-1]) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in pairwise([0, *ends.tolist(), len(hub)]):
            sims = data[low:high] @ data[low:high].T
            able = (fresh[low:high, None] | fresh[None, low:high]) & (sims > least[low:high, None])
            np.fill_diagonal(able, False)
            a, b = np.nonzero(able)
            if len(a):
                out.append((node[low + a], node[low + b], sims[a, b]))
        if out:
            yield _edges(*(np.concatenate(x) for x in zip(*out)))


def _by_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        hub = table.column(0).to_numpy()
        cut = int(np.flatnonzero(hub != hub[-1])[-1]) + 1 if hub[0] != hub[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _nearest(edges: DataFrame, k: int, by: str = "node") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("sim"), "near")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def distinct_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): one node for each different vector, under its smallest vec_id, and
    the k + 1 smallest ids of each node; no query returns more of equal vectors."""
    sound = vectors.select(F.col("vec_id").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    )
    lengths = sound.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    usual = lengths.first()
    sound = sound.where(F.size("embedding") == (usual["length"] if usual else 0))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    members = sound.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    members = written(members, "members")
    nodes = members.where("place = 1").select(F.col("vec_id").alias("node"), "embedding")
    return written(nodes, "nodes"), members


def _first_edges(nodes: DataFrame) -> DataFrame:
    """Near pairs (node, near, sim), with repeats, to start from.

    Planes halfway between two random nodes each put all nodes in order, in several orders
    anew; nodes beside each other in one are compared. Random pieces alone would hold the
    share START_ROWS / nodes of all near pairs, which falls with the table's size.
    """
    total = nodes.count()
    doublings = max(0, total - 1).bit_length() - (START_ROWS - 1).bit_length()
    # Two planes more than doublings: where planes part nodes unevenly, more are needed.
    orders, planes = (ORDERS * doublings, doublings + 2) if doublings > 0 else (1, 0)
    ends = nodes.orderBy(F.xxhash64("node"), "node").limit(2 * orders * planes).collect()
    if planes:
        points = np.array([row["embedding"] for row in ends], np.float64).reshape(2, orders, planes, -1)
        normals = points[0] - points[1]
        offsets = (normals * (points[0] + points[1])).sum(axis=-1) / 2
    else:
        normals, offsets = np.zeros((1, 0, 0)), np.zeros((1, 0))
    schema = f"order_no int, code long, node long, embedding {nodes.schema['embedding'].dataType.simpleString()}"
    placed = nodes.select("node", "embedding").mapInArrow(partial(_placed_rows, normals=normals, offsets=offsets), schema)
    # The node's hash parts equal codes, so that no range is hot.
    by = ["order_no", "code", F.xxhash64("node")]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_start_rows, _EDGE)


def build(nodes: DataFrame) -> DataFrame:
    """The neighbour graph (node, near, sim) of nodes (node, embedding) by NN-descent.

    In each round a node's neighbours and some nodes that point to it meet, and pairs with
    a new edge between them and the node are compared; what is nearer than the farthest
    neighbour held so far is passed on, and each node keeps the nearest DEGREE.
    """
    graph = _first_edges(nodes).groupBy("node", "near").agg(F.max("sim").alias("sim"))
    graph = _nearest(graph, DEGREE).withColumn("fresh", F.lit(True))
    graph = written(graph, "graph")
    total = graph.count()
    while True:
        held = graph.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n"))
        # A node that still lacks neighbours takes any.
        least = nodes.join(held, "node", "left").select(
            "node", F.when(F.col("n") >= DEGREE, F.col("low")).otherwise(float("-inf")).alias("least"), "embedding"
        )
        random = Window.partitionBy("near").orderBy(F.desc("fresh"), F.hash("node", "near"))
        back = graph.withColumn("place", F.row_number().over(random)).where(F.col("place") <= REVERSE)
        pairs = graph.select(F.col("node").alias("hub"), F.col("near").alias("node"), "fresh").unionByName(
            back.select(F.col("near").alias("hub"), "node", "fresh")
        )
        pairs = pairs.groupBy("hub", "node").agg(F.max("fresh").alias("fresh"))
        busy = pairs.where("fresh").select("hub").distinct()
        met = pairs.join(busy, "hub", "left_semi").join(least, "node").select("hub", "node", "fresh", "least", "embedding")
        met = met.repartition("hub").sortWithinPartitions("hub")
        found = met.mapInArrow(_local_joins, _EDGE).withColumn("fresh", F.lit(True))
        merged = graph.withColumn("fresh", F.lit(False)).unionByName(found)
        merged = merged.groupBy("node", "near").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        graph = written(_nearest(merged, DEGREE), "graph")
        if graph.where("fresh").count() <= FEW_NEW * total:
            return graph.select("node", "near", "sim")


def _inner(a: str, b: str) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda total, x: total + x)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, near, sim): for each query node the BEAM nodes it found, itself among them.

    Greedy: a query starts at its own node, expands every node in its beam once, both along
    edges and against them, and ends when its beam holds none that isn't expanded.
    """
    back = Window.partitionBy("near").orderBy(F.desc("sim"), "node")
    against = graph.withColumn("place", F.row_number().over(back)).where(F.col("place") <= DEGREE)
    links = graph.select("node", "near").unionByName(against.select(F.col("near").alias("node"), F.col("node").alias("near")))
    links = written(links.distinct(), "links").withColumnsRenamed({"node": "at", "near": "next"})
    start = nodes.join(queries, "node", "left_semi").withColumnRenamed("embedding", "query")
    start = written(start, "starts")
    beam = start.select("node", F.col("node").alias("near"), _inner("query", "query").alias("sim"), F.lit(False).alias("done"))
    vectors = nodes.select(F.col("node").alias("near"), "embedding")
    while True:
        steps = beam.where("not done").join(links, beam.near == links.at).select("node", F.col("next").alias("near"))
        steps = steps.distinct().join(beam.select("node", "near"), ["node", "near"], "left_anti")
        scored = steps.join(vectors, "near").join(start, "node").select(
            "node", "near", _inner("query", "embedding").alias("sim"), F.lit(False).alias("done")
        )
        beam = written(_nearest(beam.withColumn("done", F.lit(True)).unionByName(scored), BEAM), "beam")
        if beam.where("not done").isEmpty():
            return beam.select("node", "near", "sim")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    Nearness is the inner product of the original vectors in double precision, ties go to the
    smaller vec_id, rows of the query's own vec_id are left out. Equal vectors share a node,
    so many of them neither crowd the graph nor get lost. Null ids, null or zero vectors and
    those with null or non-finite components take no part; rows alike in id and vector count
    once. Vectors of another length than most have take no part. An empty table gives no rows.
    """
    nodes, members = distinct_vectors(vectors, k)
    graph = build(nodes)
    first = members.where("place = 1").select(F.col("vec_id").alias("node"), "embedding")
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").where(is_query).distinct()
    asked = written(asked.join(first, "embedding").select("query_id", "node"), "asked")
    found = search(nodes, graph, asked.select("node").distinct())
    of = members.join(first, "embedding").select("vec_id", F.col("node").alias("near"))
    hits = asked.join(found, "node").join(of, "near").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("sim").alias("score"))
