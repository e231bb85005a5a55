"""Every report stays correct when one key holds a third of the rows
(compared with the literal SQL in DuckDB on the same files)."""

from __future__ import annotations

import duckdb
import pytest
from oracle_compare import compare
from skew_shop import skewed_tables

from shoplens.operators.prep import publish
from shoplens.plans.oracle_sql import report_queries
from shoplens.plans.reports import REPORTS
from shoplens.sources.tables import SCHEMAS, read_catalog


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("skew"))
    publish(skewed_tables(spark, 1), root, catalog_prefix="skew_")
    con = duckdb.connect()
    for name in SCHEMAS:
        view = "shop_orders" if name == "orders" else name
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{root}/{name}/*.parquet')")
    return read_catalog(spark, prefix="skew_"), con


def test_hot_keys_exist(hot):
    t, con = hot
    n = t.orders.count()
    assert t.orders.where("user_id = 1").count() * 3 >= n
    assert t.website_pageviews.where("website_session_id = 0").count() * 3 >= t.website_pageviews.count()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_under_hot_keys(hot, name):
    t, con = hot
    ok, msg = compare(REPORTS[name](t), report_queries()[name], con)
    assert ok, msg
