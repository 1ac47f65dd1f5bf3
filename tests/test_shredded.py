"""Shredded field columns hold what the map holds; stored tables join without an exchange."""

import re

import pytest
from pyspark.sql import functions as F

from fieldeval.operators import accuracy, align, capability, fields, rates
from fieldeval.operators.shredded import Fields, save_by_document, shred, unshred
from fieldeval.schema import DEFAULT_SPEC, FieldSpec

SPEC = FieldSpec.of(("TOTAL", "GST", "ABN"))
ROWS = "doc_id string, model string, successful boolean, processing_time double, extraction_time double, extracted_fields map<string,string>"


@pytest.fixture(scope="module")
def rows(spark):
    maps = [
        {"TOTAL": "1", "GST": "N/A"},
        {"TOTAL": None, "other": "x", "ABN": ""},
        {},
        None,
        {"other": None, "gst": "2"},
        {"TOTAL": "1", "GST": "2", "ABN": "3", "a": "b", "c": None},
    ]
    data = [(f"d{k}", m, True, 1.0, 2.0, x) for k, x in enumerate(maps) for m in ("a", "b")]
    return spark.createDataFrame(data, ROWS)


def found(df):
    return sorted(map(str, df.collect()))


def test_round_trip(rows):
    back = {(r["doc_id"], r["model"]): r["extracted_fields"] for r in unshred(shred(rows, SPEC)).collect()}
    assert back == {(r["doc_id"], r["model"]): r["extracted_fields"] for r in rows.collect()}


def test_fields_read_alike(rows):
    both = [rows, shred(rows, SPEC)]
    for expression in (
        lambda f: f.count(),
        lambda f: f.get("TOTAL"),
        lambda f: f.get("other"),
        lambda f: f.count_of(("TOTAL", "other", "none")),
        lambda f: F.array_sort(f.keys()),
        lambda f: F.array_sort(F.array_compact(f.values())),
    ):
        one, two = (found(df.select("doc_id", "model", expression(Fields(df)).alias("x"))) for df in both)
        assert one == two


@pytest.mark.parametrize("spec", [SPEC, FieldSpec.of(("GST", "other", "new"))])
def test_operators_read_alike(spark, rows, spec):
    truth = spark.createDataFrame(
        [("d0", {"TOTAL": "1", "GST": "5"}), ("d1", {"ABN": "7", "x": "y"}), ("d5", {"TOTAL": "1 "}), ("d4", {})],
        "doc_id string, truth_fields map<string,string>",
    )
    stored, true = shred(rows, SPEC), shred(truth, SPEC, "truth_fields")
    for run in (
        lambda r, t: accuracy.document_accuracy(r, t, spec),
        lambda r, t: align.align_with_truth(r, t, spec, "successful"),
        lambda r, t: align.score_documents(r, t, spec).select("doc_id", "model", "scores"),
        lambda r, t: accuracy.match_fields(r, t, spec),
        lambda r, t: rates.field_rates(r, spec),
        lambda r, t: rates.model_quality(r),
        lambda r, t: fields.to_wide(r, spec, "doc_id", "model"),
        lambda r, t: fields.to_long(fields.restrict_to_spec(r, spec), "doc_id", "model"),
        lambda r, t: capability.extraction_capability(r, spec),
        lambda r, t: accuracy.non_na_fields(r),
        lambda r, t: accuracy.sparse_documents(r, 2).select("doc_id", "model", "filled"),
    ):
        assert found(run(rows, truth)) == found(run(stored, true))
    assert found(align.score_documents(rows, true, spec).select("scores")) == found(
        align.score_documents(rows, truth, spec).select("scores")
    )


@pytest.fixture
def tables(spark, rows, folder):
    truth = rows.where("model = 'a'").select("doc_id", F.col("extracted_fields").alias("truth_fields"))
    name = re.sub(r"\W", "_", folder)
    stored = save_by_document(shred(rows, SPEC), f"r{name}", f"{folder}/r", 4)
    true = save_by_document(shred(truth, SPEC, "truth_fields"), f"t{name}", f"{folder}/t", 4)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    yield stored, true, truth
    spark.conf.set(threshold, before)
    for table in ("r", "t"):
        spark.sql(f"DROP TABLE {table}{name}")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_stored_tables_need_no_exchange(spark, rows, tables):
    stored, true, truth = tables
    scored = align.score_fields(align.align_with_truth(stored, true, SPEC))
    for df in (
        align.with_truth(stored, true),
        accuracy.document_accuracy(stored, true, SPEC),
        accuracy.document_evaluation(scored),
        accuracy.truth_match_report(accuracy.match_fields(stored, true, SPEC)),
    ):
        assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
    assert "Exchange" in plan(accuracy.document_accuracy(rows, truth, SPEC))
    assert found(accuracy.document_accuracy(stored, true, SPEC)) == found(accuracy.document_accuracy(rows, truth, SPEC))


def test_each_bucket_is_one_file(tables):
    assert len(tables[0].inputFiles()) <= 4


def test_only_asked_fields_are_read(tables):
    stored = tables[0]
    wide = plan(fields.to_wide(stored, FieldSpec.of(("GST",)), "doc_id"))
    schema = re.search(r"ReadSchema: (\S+)", wide).group(1)
    assert "GST" in schema and "TOTAL" not in schema and "__rest" not in schema
    rated = re.search(r"ReadSchema: (\S+)", plan(rates.field_rates(stored, FieldSpec.of(("GST", "ABN"))))).group(1)
    assert "ABN" in rated and "TOTAL" not in rated and "__rest" not in rated


def test_default_spec_has_no_clashing_names():
    assert not any(n.startswith("__") for n in DEFAULT_SPEC.names)
