"""Every query against its SQL statement."""

import pytest

import __spark_entry__ as driver
from checks import oracle
from checks.compare import connect, difference
from quotaline.plans import catalog, refresh
from quotaline.plans.catalog import Lake
from tests.conftest import MEDIUM, SMALL

QUERIES, STATEMENTS = catalog.queries(), oracle.statements()


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(driver.queries()) and set(STATEMENTS) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    assert difference(df.collect(), df.columns, database, STATEMENTS[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 826


# Rows per table at the medium scale, where some reps and customers are dropped for their missing names.
ANCHORS = {
    "sales_reps": 98, "customers": 1485, "invoices": 56452, "orders": 14851, "deals": 13365,
    "gold_rep_monthly_summary": 8262, "gold_active_deals": 11879, "gold_invoice_details": 56452,
    "gold_category_summary": 663,
}


def test_row_counts_at_medium_scale(spark):
    lake = Lake(spark, MEDIUM)
    tables = {**{n: lake.silver[n] for n in refresh.SILVER}, **{n: lake.gold[n] for n in refresh.GOLD}}
    assert {name: df.count() for name, df in tables.items()} == ANCHORS


def test_summary_at_medium_scale(spark):
    name = "gold_rep_monthly_summary"
    df = QUERIES[name](spark, MEDIUM)
    assert difference(df.collect(), df.columns, connect(MEDIUM), STATEMENTS[name]) is None
    rows = df.collect()
    assert sum(r.total_invoiced > 0 and r.total_confirmed_orders > 0 and r.total_pipeline_value > 0 for r in rows) == 4826
    assert sum(r.invoice_count == 0 for r in rows) == 13
    assert sum(r.confirmed_order_count == 0 for r in rows) == 1918
    assert sum(r.active_deal_count == 0 for r in rows) == 2021
    assert sum(r.rep_name is None for r in rows) == 165
