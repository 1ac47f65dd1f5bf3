"""Searches and mixing against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldeval.llm import mixing, nndescent, topk

VECTORS = "vec_id long, embedding array<float>"
SF = "/root/testdata/sf0.01"


def vectors(seed, n=700, d=8):
    rng = np.random.default_rng(seed)
    data = rng.normal(0, 0.3, (n, d)) + rng.integers(0, 3, (n, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(data.astype(np.float32))]
    rows += [(3000 + k, rows[7][1]) for k in range(60)]  # many equal vectors
    rows += [rows[3], rows[0], (5000, None), (5100, [1.0, None] + [0.0] * (d - 2)), (5200, [float("nan")] * d), (None, rows[1][1])]
    rows += [(5300, [float("inf")] * d), (5400, [0.0] * d)]
    return rows


def sound(rows, zero):
    out = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[k] = v
    return np.array(list(out)), np.array(list(out.values()), np.float64)


def best(scores, ids, own, k):
    scores, ids = scores[ids != own], ids[ids != own]
    top = np.lexsort((ids, -scores))[:k]
    return [(i + 1, int(ids[t]), scores[t]) for i, t in enumerate(top)]


@pytest.mark.parametrize("shard, numbers", [(topk.SHARD, topk.BLOCK_NUMBERS), (90, 24)])
def test_top_k(spark, monkeypatch, shard, numbers):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", numbers)
    rows = vectors(1)
    table = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", score string").repartition(3)
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, data = sound(rows, True)
    whole = np.floor(1024 * data).astype(np.int64)
    asked = [k for k in ids if k % 100 == 0]
    assert set(got) == set(asked)
    for k in asked:
        assert sorted(got[k]) == best(whole @ whole[ids == k][0], ids, k, 10)


def test_top_k_small(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0]), (3, [1.0, 2.0])], VECTORS)
    got = [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    scale = topk.SCALE**2
    assert got == [(0, 1, 1, 2 * scale), (0, 2, 2, 2 * scale)]


def test_nearest(spark):
    rows = vectors(2, n=1500)
    table = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", node int")
    got = {}
    for r in nndescent.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, data = sound(rows, False)
    asked = [k for k in ids if k % 20 == 0]
    assert set(got) == set(asked)
    hits = 0
    for k in asked:
        found = sorted(got[k])
        scores = data @ data[ids == k][0]
        at = {int(i): s for i, s in zip(ids, scores)}
        assert [x[0] for x in found] == list(range(1, 21)) and k not in [x[1] for x in found]
        assert all(abs(at[v] - s) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        hits += len({x[1] for x in best(scores, ids, k, 20)} & {x[1] for x in found})
    assert hits >= 0.9 * 20 * len(asked)


def test_graph_of_many_pieces(spark, monkeypatch):
    """Vectors without clusters, many times START_ROWS, as in tables far larger."""
    for name, value in (("START_ROWS", 64), ("DEGREE", 8), ("REVERSE", 8)):
        monkeypatch.setattr(nndescent, name, value)
    data = np.random.default_rng(4).normal(size=(6000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "node long, embedding array<double>")
    held = {}
    for r in nndescent.build(nodes).collect():
        held.setdefault(r["node"], set()).add(r["near"])
    assert set(held) == set(range(6000)) and all(len(x) == 8 for x in held.values())
    hits = sum(len({x[1] for x in best(data @ data[k], np.arange(6000), k, 8)} & held[k]) for k in range(0, 6000, 20))
    assert hits >= 0.7 * 8 * 300, hits / 2400


def test_nearest_small(spark):
    none = spark.createDataFrame([], VECTORS)
    assert nndescent.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0])], VECTORS)
    got = [tuple(r) for r in nndescent.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]


def plain_targets(sizes):
    """Weights 1, 2, 3 in turn; full sources held, the rest shared again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, held = sum(sizes.values()), {s for s in order if sizes[s] == 0}
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return {s: Fraction(3 * sizes[s]) for s in order}
        left = Fraction(total - sum(3 * sizes[s] for s in held), sum(weight[s] for s in free))
        over = {s for s in free if left * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: Fraction(3 * sizes[s]) if s in held else left * weight[s] for s in order}
        held |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "B", "é", None, ""]), 1) for k in range(600)]
    rows += [(700, None, "a", 1), (701, "one", "zz", 1), (702, "", "none", 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    got = mixing.shares(docs).collect()
    assert len(got) == len(rows)
    want = plain_targets(sizes)
    taken = {}
    source_of = {k: s for k, _, s, _ in rows}
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, aim in want.items():
        assert abs(taken[source] - aim) <= 0.2 * aim + 60
    again = sorted(map(tuple, mixing.shares(docs.repartition(7)).collect()))
    assert sorted(map(tuple, got)) == again
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} == {1}
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(taken.values())
    nothing = docs.where("false")
    assert mixing.shares(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_mixing_by_shuffle(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.shares(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.shares(docs).collect())) == want
