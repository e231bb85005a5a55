"""Differential test: every report vs its literal SQL (DuckDB) on random
shop tables full of NULLs, ties and duplicates."""

from __future__ import annotations

import duckdb
import pytest
from oracle_compare import compare
from random_shop import random_tables

from shoplens.operators.prep import publish
from shoplens.plans.oracle_sql import report_queries
from shoplens.plans.reports import REPORTS
from shoplens.sources.tables import SCHEMAS, read_published
from shoplens.sources.versions import latest

SEEDS = [1, 2]


@pytest.fixture(scope="module", params=SEEDS)
def shop(request, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp(f"shop{request.param}"))
    publish(random_tables(spark, request.param), root)
    folders = latest(spark, root)["tables"]
    con = duckdb.connect()
    for name in SCHEMAS:
        view = "shop_orders" if name == "orders" else name
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{folders[name][0]}/*.parquet')")
    return read_published(spark, root), con


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_matches_literal_sql(shop, name):
    t, con = shop
    ok, msg = compare(REPORTS[name](t), report_queries()[name], con)
    assert ok, msg


def test_report_matches_literal_sql_without_summary(shop):
    t, con = shop
    t = t.with_summary(None)
    for name in ["entry_pages", "landing_bounce_rate", "session_buy_tags", "landing_status"]:
        ok, msg = compare(REPORTS[name](t), report_queries()[name], con)
        assert ok, f"{name}: {msg}"
