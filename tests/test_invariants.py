"""Invariants on the sf0.01 fixtures."""

from __future__ import annotations

import math

import pytest
from places import SF_ORACLE
from pyspark.sql import functions as F

from shoplens.operators import customers, financials, prep, products, website
from shoplens.sources.fixture import fixture_tables


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF_ORACLE)


def test_annual_totals_equal_column_totals(t):
    fin = financials.period_inflow(t.orders).agg(F.sum("qty_sold"), F.sum("revenue")).first()
    base = t.orders.agg(F.sum("items_purchased"), F.sum("price_usd")).first()
    assert fin[0] == base[0]
    assert math.isclose(fin[1], float(base[1]), rel_tol=1e-12)


def test_refund_shares_sum_to_100(t):
    s = products.product_refund_share(t.order_items, t.order_item_refunds, t.products).agg(
        F.sum("pct_refund_volume")).first()[0]
    assert math.isclose(s, 100.0, rel_tol=1e-9)


@pytest.mark.parametrize("which", ["orders", "web_orders"])
def test_histogram_buckets_sum_to_customers(t, which):
    o = getattr(t, which)
    n = o.select("user_id").distinct().count()
    hist = customers.lifetime_order_histogram(o)
    assert hist.agg(F.sum("users_per_bucket")).first()[0] == n
    first = customers.sequence_by_period(o).agg(F.sum("first_orders")).first()[0]
    assert first == n
    buckets = customers.lifetime_spend_buckets(o).agg(F.sum("customers")).first()[0]
    assert buckets == n


def test_literal_revenue_at_least_attributed(t):
    lit = {r.week: r for r in customers.revenue_per_visitor_session(t.website_sessions, t.web_orders, "week").collect()}
    att = {r.week: r for r in customers.revenue_per_visitor_session_attributed(
        t.website_sessions, t.web_orders, "week").collect()}
    assert lit.keys() == att.keys()
    for k in lit:
        assert (lit[k].revenue_per_session or 0) >= (att[k].revenue_per_session or 0)


def test_paid_plus_unpaid_is_100(t):
    r = website.paid_share(t.website_sessions).first()
    assert math.isclose(r.pct_paid_traffic + r.pct_unpaid_traffic, 100.0)


def test_bounces_never_exceed_sessions(t):
    for r in website.landing_bounce_rate(t.website_pageviews).collect():
        assert 0 <= r.bounces <= r.sessions
    total = website.entry_pages(t.website_pageviews).agg(F.sum("sessions")).first()[0]
    assert total == t.website_pageviews.select("website_session_id").distinct().count()


def test_recode_keeps_rows(t):
    out = prep.recode(t.website_pageviews, "pageview_url", "pageview_url", {"/view-0": "/x"})
    assert out.count() == t.website_pageviews.count()
    assert out.where(F.col("pageview_url") == "/view-0").count() == 0
