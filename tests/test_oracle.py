"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from compare import difference, duck
from revlens.workload import fixtures

SF = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


ROUNDED = ["article_agreement", "agreement_geojson", "survey_articles", "survey_geojson"]


@pytest.mark.parametrize("name", ROUNDED)
def test_means_on_a_rounding_border(spark, name):
    """Larger tables hold means that lie between two roundings; the split of the rows must not decide."""
    larger = SF.replace("0.001", "0.01")
    assert difference(QUERIES[name](spark, larger).repartition(3), duck(larger), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_random_queue_is_unlabelled(spark):
    ids = {r["id"] for r in QUERIES["review_queue_random"](spark, SF).collect()}
    pending = {r["id"] for r in fixtures.event_rev(spark, SF).filter("manual_bias is null").select("id").collect()}
    assert 0 < len(ids) <= 100 and ids <= pending
