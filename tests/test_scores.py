from pyspark.sql import functions as F

from fieldeval.functions import score
from fieldeval.operators import align, runs
from fieldeval.schema import FieldSpec

CASES = [
    # extracted, truth, field, score, documented score, match
    ("$46.68", "46.68", "TOTAL", 1.0, 1.0, True),
    ("-5.00", "5.00", "TOTAL", 1.0, 0.0, True),
    ("abc", "abc", "GST", 1.0, 1.0, True),
    ("", "0.0", "GST", 1.0, 0.0, False),
    ("a | B", "A|b", "QUANTITIES", 1.0, 1.0, False),
    ("a|x", "a|b", "PRICES", 0.5, 0.5, False),
    ("$3.80, $8.50", "$3.80 | $8.50", "PRICES", 0.0, 0.0, False),
    ("Acme", "Acme Ltd", "SUPPLIER", 0.8, 0.8, False),
    ("", "", "ABN", 1.0, 1.0, True),
    ("N/A", "", "ABN", 0.0, 1.0, False),
    ("nil", "N/A", "ABN", 0.0, 1.0, False),
    ("on 05/09/2025", "05/09/2025", "DATE", 1.0, 0.8, False),
    ("on 05/09/2025", "05/09/2025", "DUE_DATE", 0.8, 1.0, False),
    ("1 high st nation", "1 High St NATION road", "PAYER_ADDRESS", 0.8, 0.8, True),
    ("$1,234", "$1,999", "TOTAL", 0.0, 0.0, True),
    ("b,a,a", "a, b", "DESCRIPTIONS", 0.0, 0.0, True),
]


def test_scores(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, e string, g string, f string")
    got = rows.select(
        "i",
        score.score_field("e", "g", "f").alias("s"),
        score.score_field_documented("e", "g", "f").alias("d"),
        score.match_field("e", "g", "f").alias("m"),
    ).orderBy("i").collect()
    for case, r in zip(CASES, got):
        assert (case, r["s"], r["d"], r["m"]) == (case, *case[3:])


def test_array_and_long_scores_agree(spark):
    spec = FieldSpec.of(("TOTAL", "PRICES", "SUPPLIER"))
    truth = spark.createDataFrame([("d", {"TOTAL": "5", "PRICES": "a|b"})], "doc_id string, truth_fields map<string,string>")
    found = spark.createDataFrame([("d", "m", {"TOTAL": "$5", "PRICES": "a|c"})], "doc_id string, model string, extracted_fields map<string,string>")
    long = align.score_fields(align.align_with_truth(found, truth, spec))
    wide = align.score_documents(found, truth, spec).select(F.inline("scores"))
    want = {("TOTAL", 1.0), ("PRICES", 0.5), ("SUPPLIER", 1.0)}
    assert {(r["field"], r["score"]) for r in long.collect()} == want
    assert {(r["field"], r["score"]) for r in wide.collect()} == want


def test_hot_name_is_split_and_complete(spark):
    """A name that fills a third of all rows is dealt to many tasks by adaptive execution."""
    name = F.when(F.col("id") < 40_000, "hot").when(F.col("id") < 50_000, " ").otherwise(F.concat(F.lit("k"), F.col("id")))
    rows = spark.range(120_000).select(name.alias("image_name"), F.concat(F.lit("/x/"), name).alias("image_path"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    images = rows.select(F.col("image_name").alias("name")).where("name <> 'k60000'").distinct()
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = align.validate_truth(rows.repartition(8), images)
        counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counts == {"valid": 109_999, "invalid": 10_000, "missing_image": 1}
    assert "isSkewJoin=true" in plan or "skew=true" in plan


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from fieldeval.operators.quantiles import counted_values, exact_quantiles

    rnd = random.Random(4)
    groups = {"few": [0.5], "two": [0.0, 1.0], "ties": [0.25] * 50 + [0.75] * 51, "many": [round(rnd.random(), 8) for _ in range(3000)]}
    groups["wide"] = [round(rnd.uniform(-50, 50), 3) for _ in range(500)]
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    for width in (10_000, 7):
        got = {(r["g"], r["share"]): r["quantile"] for r in exact_quantiles(counted_values(table, "g", "v"), "g", shares, width=width).collect()}
        assert got.keys() == {(g, s) for g in groups for s in shares}
        for g, vs in groups.items():
            assert np.allclose([got[g, s] for s in shares], np.quantile(vs, shares), atol=1e-9)


def test_quartiles_score_documents_once(spark, folder):
    from fieldeval.operators.accuracy import describe_accuracy

    spark.createDataFrame([("a", k / 7) for k in range(8)], "model string, accuracy double").write.parquet(f"{folder}/d")
    found = describe_accuracy(spark.read.parquet(f"{folder}/d"))
    row = found.collect()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert (row["count"], round(row["q50"], 8), row["max"]) == (8, 0.5, 1.0)
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 1


def test_requested_model_without_rows_has_failed(spark):
    from fieldeval.operators.accuracy import model_accuracy

    docs = spark.createDataFrame(
        [("d", "a", True, 2.0, 0.5, 3, 4)],
        "doc_id string, model string, successful boolean, processing_time double, accuracy double, truth_fields long, extracted_fields int",
    )
    asked = spark.range(5).select(F.col("id").cast("string").alias("doc_id"))
    got = {r["model"]: (r["total_images"], r["successful"], r["failed"], r["success_rate"], r["avg_accuracy"]) for r in model_accuracy(docs, asked, ("a", "b")).collect()}
    assert got == {"a": (5, 1, 4, 0.2, 0.5), "b": (5, 0, 5, 0.0, 0.0)}
    assert {r["model"]: r["failed"] for r in model_accuracy(docs, models=("b",)).collect()} == {"a": 0, "b": 0}


def test_reports_scan_results_once(spark, folder):
    from fieldeval.operators import profile, rates
    from fieldeval.operators.accuracy import overview_summary, overview_table
    from fieldeval.schema import DEFAULT_SPEC

    rows = [("d", "a", True, 1.0, {"TOTAL": "1"}), ("e", "a", None, 2.0, {"TOTAL": "N/A", "x": "y"}), ("d", "b", False, 3.0, None)]
    kind = "doc_id string, model string, successful boolean, processing_time double, extracted_fields map<string,string>"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/results")
    results = spark.read.parquet(f"{folder}/results")
    truth = spark.createDataFrame([("d", {"TOTAL": "1"})], "doc_id string, truth_fields map<string,string>")
    run = profile.run_profile(results, DEFAULT_SPEC)
    usage = spark.createDataFrame([("a", 1.0)], "model string, memory_gb double")
    reports = [
        rates.winners(profile.model_profile(run)),
        profile.normalise_profile(run, DEFAULT_SPEC, 2),
        overview_table(overview_summary(results, truth, DEFAULT_SPEC), None, usage),
    ]
    for report in reports:
        assert report._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    per = {r["model"]: r for r in profile.model_profile(run).collect()}
    assert (per["a"]["documents"], per["a"]["successful"], per["a"]["avg_fields_extracted"], per["a"]["non_na_fields"]) == (2, 1, 1.5, 1.0)
    old = rates.normalise_runs(rates.field_rates(results, DEFAULT_SPEC), rates.model_success(results), DEFAULT_SPEC, 2)
    assert sorted(map(str, old.collect())) == sorted(map(str, reports[1].select(*old.columns).collect()))


def test_resource_compare_needs_two_runs(spark):
    one = spark.createDataFrame([("a", 2.0, 5)], "run_id string, peak_process_gb double, total_snapshots long")
    assert runs.resource_compare(one, {"a": 1.0}).count() == 0


def test_documents_without_truth_and_equal_rows(spark):
    from fieldeval.operators.accuracy import document_accuracy, model_accuracy
    from fieldeval.operators.align import missing_truth
    from fieldeval.schema import FieldSpec

    spec = FieldSpec.of(("SUPPLIER", "ABN"))
    kind = "doc_id string, model string, successful boolean, processing_time double, extracted_fields map<string,string>"
    row = ("a", "m", True, 1.0, {"SUPPLIER": "x"})
    results = spark.createDataFrame([row, row, ("b", "m", True, 1.0, {"SUPPLIER": "x"})], kind)
    truth = spark.createDataFrame([("a", {"SUPPLIER": "x"})], "doc_id string, truth_fields map<string,string>")
    got = sorted(map(tuple, document_accuracy(results, truth, spec).collect()))
    assert got == [("a", "m", True, 1.0, 1.0, 1, 1)] * 2 + [("b", "m", True, 1.0, 0.5, 0, 1)]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    total = model_accuracy(document_accuracy(results, truth, spec).where("doc_id = 'b'"), asked).first()
    assert (total["total_images"], total["successful"], total["failed"], total["success_rate"]) == (4, 1, 3, 0.25)
    assert [r["doc_id"] for r in missing_truth(results, truth).collect()] == ["b"]


def test_null_models_and_flags(spark):
    from fieldeval.operators import capability, rates, runs
    from fieldeval.schema import FieldSpec

    rows = spark.createDataFrame(
        [("m", True, 1.0, "a", None), (None, None, 2.0, "b", "e")],
        "model string, successful boolean, processing_time double, doc_id string, error string",
    )
    assert sorted(r["model"] or "" for r in rates.success_metrics(rows).collect()) == ["", "(overall)", "m"]
    assert sorted(r["model"] or "" for r in rates.run_overview(rows, 1).collect()) == ["", "m"]
    assert [r["doc_id"] for r in runs.first_failures(rows).collect()] == ["b"]
    known = spark.createDataFrame(
        [("m", True, 1.0, None, {"ABN": "1"})],
        "model string, successful boolean, extraction_time double, field_count int, extracted_fields map<string,string>",
    )
    assert capability.extraction_capability(known, FieldSpec.of(("ABN",))).first()["information_density"] == 1.0


def test_long_field_lists(spark):
    from fieldeval.operators.fields import restrict_to_fields
    from fieldeval.schema import FieldSpec

    assert len(FieldSpec.of(f"F{k}" for k in range(1001))) == 1001
    long = spark.createDataFrame([("d", "F1", "x"), ("d", "G", "y")], "doc_id string, field string, value string")
    fields = spark.createDataFrame([(f"F{k}",) for k in range(1001)], "field string")
    assert [r["field"] for r in restrict_to_fields(long, fields).collect()] == ["F1"]
