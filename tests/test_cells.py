"""Scoring of a document's fields as columns: plan and results."""

from fieldeval.functions.score import match_field, score_field, score_field_documented
from fieldeval.operators import accuracy, align
from fieldeval.schema import DEFAULT_SPEC, FieldSpec

RESULTS = "doc_id string, model string, successful boolean, processing_time double, extracted_fields map<string,string>"
TRUTH = "doc_id string, truth_fields map<string,string>"


def _tables(spark):
    results = [
        ("a", "m", True, 1.0, {"TOTAL": "$5.00", "GST": "0", "SUPPLIER": " Acme ", "QUANTITIES": "1 | 2", "X": "y"}),
        ("a", "n", False, 1.0, {}),
        ("b", "m", True, 2.0, None),
        ("c", "m", True, None, {"TOTAL": "", "PAYER_ADDRESS": "1 high street", "PRICES": "$1|$2"}),
        (None, "m", True, 3.0, {"TOTAL": "N/A"}),
    ]
    truth = [
        ("a", {"TOTAL": "5", "GST": "0.00", "SUPPLIER": "acme", "QUANTITIES": "1|3"}),
        ("b", {"TOTAL": "abc", "SUPPLIER": None}),
        ("d", {"TOTAL": "1"}),
        ("c", {"TOTAL": "1", "PAYER_ADDRESS": "1 High  Street North", "PRICES": "$1|$2|$3"}),
    ]
    return spark.createDataFrame(results, RESULTS), spark.createDataFrame(truth, TRUTH)


def test_fields_are_scored_without_lambdas(spark):
    """A lambda is interpreted for every value; columns are compiled."""
    results, truth = _tables(spark)
    spec = FieldSpec.of(("TOTAL", "GST", "SUPPLIER", "INVOICE_DATE"))
    plan = align.score_documents(results, truth, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert "score" in plan and "lambda" not in plan


def test_cells_have_the_scores_of_long_rows(spark):
    results, truth = _tables(spark)
    for scorer in (score_field, score_field_documented, match_field):
        for absent, how in (("", "left"), ("N/A", "inner"), (None, "left")):
            aligned = align.align_with_truth(results, truth, DEFAULT_SPEC, "successful", absent=absent, how=how)
            long = align.score_fields(aligned, scorer)
            cells = align.aligned_scores(
                results, truth, DEFAULT_SPEC, "successful", scorer=scorer, absent=absent, how=how
            )
            assert cells.columns == long.columns
            assert sorted(map(str, cells.collect())) == sorted(map(str, long.collect()))


def test_documents_without_map_or_truth(spark):
    results, truth = _tables(spark)
    docs = accuracy.document_accuracy(results, truth, FieldSpec.of(("TOTAL", "SUPPLIER")))
    found = {(r.doc_id, r.model): (r.accuracy, r.truth_fields) for r in docs.collect()}
    assert found == {
        ("a", "m"): (1.0, 2),
        ("a", "n"): (None, None),
        ("b", "m"): (0.5, 1),
        ("c", "m"): (0.5, 1),
        (None, "m"): (0.5, 0),
    }
