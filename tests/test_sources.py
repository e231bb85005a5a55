"""Loaders, SQL views over the shop schema, the CLI sink."""

from __future__ import annotations

from places import SF_SMOKE
from pyspark.sql import functions as F

from shoplens.operators import financials
from shoplens.sources.fixture import fixture_tables
from shoplens.sources.tables import read_catalog, read_published, register_views


def test_views_run_shop_sql(spark):
    t = fixture_tables(spark, SF_SMOKE)
    register_views(t, prefix="shop_")
    # SQL over the views and the DataFrames see the same orders.
    sql = spark.sql("SELECT items_purchased, count(*) AS orders FROM shop_orders GROUP BY items_purchased")
    api = t.orders.groupBy("items_purchased").count()
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect()))
    again = read_catalog(spark, prefix="shop_")
    assert again.orders.count() == t.orders.count()


def test_cli_writes_reports(spark, tmp_path):
    from shoplens.__main__ import main
    from shoplens.operators.prep import publish

    root = str(tmp_path / "pub")
    publish(fixture_tables(spark, SF_SMOKE), root)
    out = str(tmp_path / "out")
    assert main(["run", "financials_annual", "funnel", "--published", root, "--out", out]) == 0
    got = spark.read.parquet(f"{out}/financials_annual")
    want = financials.period_financials(*(lambda t: (t.orders, t.order_item_refunds))(read_published(spark, root)))
    assert got.count() == want.count() > 0
    assert got.agg(F.sum("qty_sold")).first()[0] == want.agg(F.sum("qty_sold")).first()[0]


def test_cli_lists_reports_and_rejects_unknown(capsys):
    import pytest

    from shoplens.__main__ import main
    from shoplens.plans.reports import REPORTS

    assert main(["list"]) == 0
    assert capsys.readouterr().out.split() == list(REPORTS)
    with pytest.raises(SystemExit):
        main(["run", "no_such_report", "--published", "/nonexistent", "--out", "/nonexistent"])


def test_six_table_shop_runs_every_report(spark):
    """A shop as the scripts know it: six tables, their URLs, orders that carry their session."""
    import datetime as dt
    from decimal import Decimal

    from shop_rows import tables

    from shoplens.plans.reports import reports

    day = dt.datetime(2015, 3, 2)
    views = ["/home", "/products", "/high-score-hoodie", "/cart", "/shipping", "/billing", "/thank-you-for-your-order"]
    t = tables(
        spark, orders=[(1, day, 1, 7, 1, 1, Decimal(50), Decimal(20))],
        order_items=[(1, day, 1, 1, 1, Decimal(50), Decimal(20))],
        order_item_refunds=[], products=[(1, day, "hoodie")],
        website_sessions=[(1, day, 7, "s", "c", "a", "mobile"), (2, day, 8, None, None, None, "desktop")],
        website_pageviews=[(i, day + dt.timedelta(minutes=i), 1, u) for i, u in enumerate(views)]
        + [(20, day, 2, "/home"), (21, day + dt.timedelta(minutes=30), 2, "/high-score-hoodie")], web_orders=[])
    for name, df in t.items():
        if name != "web_orders":
            df.createOrReplaceTempView(f"six_{name}")
    shop = read_catalog(spark, prefix="six_")
    found = {name: report(shop).collect() for name, report in reports().items()}
    assert [tuple(r) for r in found["funnel"]][0][:4] == (2015, 2, 150.0, 3)
    assert {(r.product_page, r.bounce_rate) for r in found["product_bounce_rate"]} == {
        ("/products", 0.0), ("/high-score-hoodie", 100.0)} or found["product_bounce_rate"]
    assert {(r.pageview_url, r.status) for r in found["landing_status"]} == {("/home", "ACTIVE")}
    assert found["order_rate"][0].order_rate == 50.0
    assert found["last_order"][0].last_recorded_order == day
