"""Appends that are repeated, killed or made side by side."""

import glob
import json
import os

import pytest

from fieldeval.sources import batches
from fieldeval.sources import writers as W

ROWS = "doc_id string, model string, successful boolean, error string, processing_time double"


def table(spark, n=20, model="m"):
    rows = [(f"d{k}", model, (True, False, None)[k % 3], None if k % 3 == 0 else f"e{k}", float(k)) for k in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def counts(spark, path):
    totals = W.read_totals(spark, path).groupBy().sum("total_images", "failed_extractions").first()
    good = W.read_results(spark, path, "doc_id string, model string").count()
    return good, W.read_failures(spark, path).count(), *totals


def test_repeated_batch_counts_once(spark, folder):
    path = f"{folder}/t"
    assert W.write_batch_results(table(spark), path, "007") is True
    assert W.write_batch_results(table(spark, 50), path, "007") is False
    assert counts(spark, path) == (7, 13, 20, 13)
    assert W.write_batch_results(table(spark, 3), path, "7") is True  # another id, not the same number
    assert counts(spark, path) == (8, 15, 23, 15)
    assert {r["batch"] for r in W.read_totals(spark, path).collect()} == {"007", "7"}


def test_no_id_makes_a_new_batch(spark, folder):
    for _ in range(2):
        W.write_batch_results(table(spark, 6), f"{folder}/t")
    assert counts(spark, f"{folder}/t") == (4, 8, 12, 8)


def test_killed_write_leaves_nothing_to_read(spark, folder, monkeypatch):
    path = f"{folder}/t"
    with monkeypatch.context() as m:
        m.setattr(batches.Batch, "publish", lambda self: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            W.write_batch_results(table(spark), path, "a")
    assert glob.glob(f"{path}/rows/batch=b-a/attempt=*/outcome=*/part-*")
    assert W.read_failures(spark, path).count() == 0 and W.read_totals(spark, path).count() == 0
    W.write_batch_results(table(spark), path, "a")
    assert counts(spark, path) == (7, 13, 20, 13)
    assert len(glob.glob(f"{path}/rows/batch=b-a/attempt=*")) == 2


def test_write_killed_between_two_tables(spark, folder, monkeypatch):
    """Both tables of a batch are published together or not at all."""
    path, rows = f"{folder}/t", table(spark).select("doc_id", "model")
    with monkeypatch.context() as m:
        m.setattr(batches.F, "current_timestamp", lambda: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            W.append_truth(rows, rows, path, batch_id="x")
    assert glob.glob(f"{path}/truth/batch=b-x/attempt=*/part-*")
    with pytest.raises(ValueError, match="nothing is published"):
        W.read_truth(spark, path)
    for _ in range(2):
        W.append_truth(rows, rows, path, batch_id="x")
    assert W.read_truth(spark, path).count() == 20
    assert batches.read_published(spark, path, "records").count() == 20


def test_side_by_side_attempts_count_once(spark, folder):
    """Two writers that both saw no published attempt: the first one published counts."""
    path = f"{folder}/t"
    both = [batches.Batch(spark, path, "z") for _ in range(2)]
    for k, batch in enumerate(both):
        assert not batch.known()
        table(spark, 5 + k).write.json(batch.place())
    for batch in reversed(both):
        batch.publish()
    assert batches.read_published(spark, path).count() == 6
    assert batches.published(spark, path).collect() == [("b-z", both[1].attempt)]


def test_comparison_rows_by_model(spark, folder):
    rows = table(spark, 4, "a").unionByName(table(spark, 5, "b"))
    for _ in range(2):
        W.write_comparison_results(rows, f"{folder}/t", "1")
    found = batches.read_published(spark, f"{folder}/t")
    assert {r["model"]: r["count"] for r in found.groupBy("model").count().collect()} == {"a": 4, "b": 5}
    assert found.where("model = 'a'").inputFiles() != []


def test_ids_are_plain(spark, folder):
    for name in ("", "a/b", "a=b", "x y"):
        with pytest.raises(ValueError):
            batches.Batch(spark, folder, name)


def test_empty_batch(spark, folder):
    path = f"{folder}/t"
    assert W.write_batch_results(spark.createDataFrame([], ROWS), path, "none")
    assert W.read_failures(spark, path).count() == 0 and W.read_totals(spark, path).count() == 0


def test_json_lists(spark, folder):
    W.write_json_lists(table(spark, 10).repartition(4), f"{folder}/l")
    found = []
    for name in glob.glob(f"{folder}/l/part-*"):
        with open(name) as f:
            found += json.load(f)
    assert sorted(r["doc_id"] for r in found) == sorted(f"d{k}" for k in range(10))
    W.write_json_lists(spark.createDataFrame([], ROWS), f"{folder}/e")
    for name in glob.glob(f"{folder}/e/part-*"):
        assert json.loads(open(name).read()) == [] and os.path.getsize(name) > 0
