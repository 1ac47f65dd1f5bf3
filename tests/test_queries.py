"""Every registered query of the library against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from fieldeval.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 50


def test_every_query_has_sql():
    assert set(CATALOG) <= set(entry.oracle_sql())


def test_all_line_items_are_listed(spark):
    """Items in the truth lists are as many as the line items of the orders."""
    from pyspark.sql import functions as F

    from fieldeval.plans import derive

    wide = derive.truth_wide(spark, SF)
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    expected = items.join(orders, items.l_orderkey == orders.o_orderkey, "left_semi").count()
    for name in ("QUANTITIES", "PRICES", "DESCRIPTIONS"):
        size = F.when(F.col(name) != "N/A", F.size(F.split(name, r" \| "))).otherwise(0)
        assert wide.agg(F.sum(size)).first()[0] == expected
