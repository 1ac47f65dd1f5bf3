"""How the derived inputs are laid out, and what reports read of them."""

from fieldeval.operators import align
from fieldeval.plans.catalog import CATALOG
from fieldeval.plans.derive import Inputs

SF = "/root/testdata/sf0.001"


def test_wide_rows_are_not_shuffled_for_the_truth_join(spark):
    """Orders and lines are dealt by document while narrow; field maps pass no exchange."""
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.enabled", "false")
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    i = Inputs(other, SF)
    plan = align.with_truth(i.results(), i.truth())._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[n + 1] for n, line in enumerate(plan) if "- Exchange" in line]
    assert len(below) >= 4
    assert not [line for line in below if "truth_fields" in line or "extracted_fields" in line]


def test_description_of_accuracies_scores_documents_once(spark):
    """What is read several times are the stored counts of values, not the documents."""
    files = CATALOG["describe_accuracy"].build(Inputs(spark, SF)).inputFiles()
    assert files and all("/accuracies-" in f for f in files)
