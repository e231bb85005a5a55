"""Hand-written rows for the semantics the rebuild must keep (SURVEY §2.D,
FIXTURES §3). Expected values are worked out by hand from the reference's
SQL, not produced by the code under test."""

from __future__ import annotations

import pytest
from shop_rows import d, item, order, pageview, refund, session, table, tables, ts

from shoplens.operators import audits, customers, financials, prep, products, website


def rows(df, *cols):
    out = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in out), key=lambda t: tuple((x is None, x) for x in t))


# Q1: sessions joined to orders on user_id fan out.
def test_q1_user_join_counts_revenue_once_per_session(spark):
    t = tables(
        spark,
        website_sessions=[session(1, "2024-01-02 10:00:00", 7), session(2, "2024-01-09 10:00:00", 7)],
        web_orders=[order(100, "2024-01-02 10:05:00", 7, 10, session=1),
                    order(101, "2024-01-02 10:06:00", 7, 20, session=1)],
    )
    lit = rows(customers.revenue_per_visitor_session(t.website_sessions, t.web_orders, "week"))
    assert lit == [("2024-01-01", 30.0, 30.0), ("2024-01-08", 30.0, 30.0)]  # 60 in total, twice the 30 sold
    att = rows(customers.revenue_per_visitor_session_attributed(t.website_sessions, t.web_orders, "week"))
    assert att == [("2024-01-01", 30.0, 30.0), ("2024-01-08", None, None)]
    assert rows(customers.visitor_buy_rate(t.website_sessions, t.web_orders, "week")) == [
        ("2024-01-01", 1.0), ("2024-01-08", 1.0)]


# Two refunded items on one order.
def test_two_refunds_on_one_order(spark):
    t = tables(
        spark,
        orders=[order(1, "2013-01-01", 1, 50, items=2), order(2, "2013-02-01", 1, 20), order(3, "2013-03-01", 2, 30)],
        order_item_refunds=[refund(11, "2013-01-05", 11, 1, 10), refund(12, "2013-01-09", 12, 1, 15),
                            refund(31, "2013-03-05", 31, 3, 30)],
    )
    o, r = t.orders, t.order_item_refunds
    assert rows(customers.pct_orders_refunded(o, r)) == [(2 / 3,)]
    assert rows(customers.refund_items_per_order(r)) == [(1, 2), (3, 1)]
    assert rows(customers.customers_by_refund_count(o, r)) == [(1, 2)]
    assert rows(customers.refund_rate(o, r)) == [(1.0,)]
    # The orders side repeats order 1 once.
    assert rows(audits.fanout_audit(o, r, "order_id", "orders", "refunds")) == [(4, 3, 1, 3, 2, 1)]
    # Order 1's sums count twice in the literal join.
    assert rows(audits.fanout_sums(o, r, "year"), "year", "revenue", "qty_sold") == [(2013, 150.0, 6)]


# Q3: "not the first refund" must not be decided by timestamp alone.
def test_q3_coincident_refund_time_hides_nothing(spark):
    r = table(spark, "order_item_refunds", [
        refund(1, "2013-01-01", 1, 10, 5), refund(2, "2013-01-02", 2, 10, 5),
        refund(3, "2013-01-02", 3, 11, 5),  # order 11's first refund shares r2's time
    ])
    assert rows(audits.repeat_refund_items(r), "order_item_refund_id") == [(2,)]


# Q6: sequence is by order id; 4th+ orders get NULL but their spend counts.
def test_q6_four_plus_orders(spark):
    o = table(spark, "orders", [
        order(50, "2014-05-01", 5, 1), order(51, "2013-01-01", 5, 2), order(52, "2012-07-01", 5, 3),
        order(53, "2015-01-01", 5, 4), order(54, "2011-01-01", 5, 5),
    ])
    assert rows(customers.order_sequence(o), "order_id", "order_sequence_id") == [
        (50, 1), (51, 2), (52, 3), (53, None), (54, None)]
    assert rows(customers.lifetime_spend_buckets(o)) == [("3 orders", 1, 15.0)]
    assert rows(customers.lifetime_order_histogram(o)) == [(5, 1, None)]
    assert rows(customers.sequence_by_period(o)) == [
        (2011, 0, 0, 0), (2012, 0, 0, 1), (2013, 0, 1, 0), (2014, 1, 0, 0), (2015, 0, 0, 0)]
    aov = rows(customers.aov_by_sequence(o))
    assert aov[-1] == (2015, None, None, None) and aov[1] == (2012, None, None, 3.0)


# Q7: tied timestamps on different pages give one row per landing page.
def test_q7_tied_timestamps(spark):
    pv = table(spark, "website_pageviews", [
        pageview(1, "2015-03-10 10:00:00", 1, "/a"), pageview(2, "2015-03-10 10:00:00", 2, "/b"),
        pageview(3, "2015-02-01 10:00:00", 3, "/c"),
    ])
    assert rows(website.landing_status(pv, "2015-03-01 00:00:00")) == [
        ("/a", ts("2015-03-10 10:00:00"), "ACTIVE"), ("/b", ts("2015-03-10 10:00:00"), "ACTIVE"),
        ("/c", ts("2015-02-01 10:00:00"), "INACTIVE")]


# Q8 / Q9: period without refunds keeps NULLs; refund-only period drops.
def test_q8_q9_refund_periods(spark):
    t = tables(
        spark,
        orders=[order(1, "2012-05-01", 1, 100, items=2, cogs=40), order(2, "2013-05-01", 2, 50, cogs=20)],
        order_item_refunds=[refund(1, "2013-06-01", 2, 2, 10), refund(2, "2014-01-01", 3, 3, 5)],
    )
    out = {r.year: r for r in financials.period_financials(t.orders, t.order_item_refunds).collect()}
    assert sorted(out) == [2012, 2013]
    y12, y13 = out[2012], out[2013]
    assert (y12.qty_refunds, y12.refund_rate, y12.refund_volume_usd, y12.total_refund_losses,
            y12.margin_less_refund_losses) == (None, None, None, None, None)
    assert (y13.qty_refunds, y13.refund_rate, y13.total_refund_losses, y13.margin_less_refund_losses) == (
        1, 1.0, 30.0, 20.0)
    assert (y12.unique_customers, y12.qty_sold, y12.revenue_usd, y12.margin, y12.aov) == (1, 2, 100.0, 60.0, 100.0)


FUNNEL = [("lander", ["/home"]), ("product", ["/p"]), ("cart", ["/cart"]),
          ("shipping", ["/ship"]), ("billing", ["/bill"]), ("thanks", ["/thanks"])]


# Q11 / Q16: zero denominators give NULL; reloads push conversion above 100 %.
def test_funnel_zero_denominator_and_reloads(spark):
    t = tables(
        spark,
        website_sessions=[session(1, "2024-01-01 09:00:00", 1), session(2, "2024-01-02 09:00:00", 2)],
        website_pageviews=[
            pageview(1, "2024-01-01 09:00:00", 1, "/home"), pageview(2, "2024-01-01 09:01:00", 1, "/p"),
            pageview(3, "2024-01-01 09:02:00", 1, "/cart"), pageview(4, "2024-01-01 09:03:00", 1, "/cart"),
            pageview(5, "2024-01-01 09:04:00", 1, "/cart"),
            pageview(6, "2024-01-02 09:00:00", 2, "/home"), pageview(7, "2024-01-02 09:01:00", 2, "/p"),
        ],
    )
    f = {r.day: r for r in website.funnel(t.website_pageviews, t.website_sessions, FUNNEL, "day").collect()}
    assert f["2024-01-01"].conversion3 == 300.0 and f["2024-01-01"].cart_pvws == 3
    assert f["2024-01-02"].conversion3 == 0.0 and f["2024-01-02"].conversion4 is None
    s = {r.day: r for r in website.funnel_sessions(t.website_pageviews, t.website_sessions, FUNNEL, "day").collect()}
    assert s["2024-01-01"].conversion3 == 100.0


# Q13 / Q14: add-ons by primary product, zero kept; companion by item product.
def test_q14_no_addons_kept(spark):
    t = tables(
        spark,
        orders=[order(1, "2013-01-01", 1, 10, items=2, product=1), order(2, "2013-01-02", 2, 10, items=2, product=2)],
        order_items=[item(11, "2013-01-01", 1, 1, 5, primary=1), item(12, "2013-01-01", 1, 3, 5, primary=1),
                     item(21, "2013-01-02", 2, 2, 5, primary=1), item(22, "2013-01-02", 2, 3, 5, primary=0)],
        products=[(1, ts("2012-01-01"), "A"), (2, ts("2012-01-01"), "B"), (3, ts("2012-01-01"), "C")],
    )
    assert rows(products.addon_items(t.orders, t.order_items, t.products)) == [(1, "A", 0), (2, "B", 1)]
    assert rows(products.addon_items_by_item_product(t.orders, t.order_items, t.products)) == [(3, "C", 1)]


# Q15: the cart is a product page without a product.
def test_q15_cart_only_session(spark):
    pages = {"/p1": 1, "/cart": None}
    pv = table(spark, "website_pageviews", [
        pageview(1, "2024-01-01 09:00:00", 1, "/cart"), pageview(2, "2024-01-01 09:00:00", 2, "/p1"),
        pageview(3, "2024-01-01 09:01:00", 2, "/cart"), pageview(4, "2024-01-01 09:00:00", 3, "/home"),
    ])
    assert rows(products.product_bounce_rate(pv, pages)) == [(1, "/p1", 0.0), (None, "/cart", 100.0)]
    assert rows(products.product_bounce_sessions(pv, pages)) == [(1, "/cart", 1)]


# AVG skips a session without pageviews; Q22 weights a 2-order session twice.
def test_avg_pageviews_buckets(spark):
    t = tables(
        spark,
        website_sessions=[session(1, "2024-01-01", 1), session(2, "2024-01-01", 2), session(3, "2024-01-01", 3),
                          session(4, "2024-01-01", 4)],
        website_pageviews=[pageview(1, "2024-01-01", 1, "/a"), pageview(2, "2024-01-01", 1, "/b"),
                           pageview(3, "2024-01-01", 3, "/a"), pageview(4, "2024-01-01", 3, "/b"),
                           pageview(5, "2024-01-01", 3, "/c"), pageview(6, "2024-01-01", 3, "/d"),
                           pageview(7, "2024-01-01", 4, "/a")],
        web_orders=[order(9, "2024-01-01", 3, 5, session=3), order(10, "2024-01-01", 4, 5, session=4),
                    order(11, "2024-01-01", 4, 5, session=4)],
    )
    got = rows(customers.avg_pageviews_by_bucket(t.website_sessions, t.web_orders, t.website_pageviews))
    assert got == [("customer", 6 / 3), ("visitor", 2.0)]  # (4 + 1 + 1) / 3 joined rows
    tags = rows(customers.session_buy_tags(t.website_sessions, t.web_orders, t.website_pageviews))
    assert tags == [(1, 2, None), (2, None, None), (3, 4, 1), (4, 1, 1), (4, 1, 1)]


# Q22: order rate counts joined rows on both sides.
def test_q22_order_rate(spark):
    t = tables(
        spark,
        website_sessions=[session(1, "2024-01-01 10:00:00", 1), session(2, "2024-01-01 11:00:00", 2)],
        web_orders=[order(1, "2024-01-01 10:05:00", 1, 5, session=1), order(2, "2024-01-01 10:06:00", 1, 5, session=1)],
    )
    assert rows(website.order_rate(t.website_sessions, t.web_orders, "day")) == [("2024-01-01", 2 / 3 * 100)]


# NULL campaign and source: kept by W6b/W7b, dropped by W8.
def test_null_campaign(spark):
    s = table(spark, "website_sessions", [
        session(1, "2012-05-01", 1, "gsearch", "brand", "g_ad_1"), session(2, "2012-06-01", 2),
        session(3, "2013-06-01", 3, "bsearch", "nonbrand", "b_ad_2", "mobile"),
    ])
    assert rows(website.paid_share(s)) == [(3, 2 / 3 * 100, 1 / 3 * 100)]
    assert rows(website.campaign_sessions(s, "year")) == [
        ("brand", "2012", 1), ("nonbrand", "2013", 1), (None, "2012", 1)]
    assert rows(website.paid_sources(s)) == [("bsearch", 1), ("gsearch", 1)]


# Q23: an item with two refund rows counts its price twice.
def test_q23_item_refunded_twice(spark):
    t = tables(
        spark,
        order_items=[item(1, "2013-01-01", 1, 1, 10, cogs=4), item(2, "2013-01-01", 1, 2, 7, cogs=1)],
        order_item_refunds=[refund(1, "2013-01-02", 1, 1, 3), refund(2, "2013-01-03", 1, 1, 4)],
        products=[(1, ts("2012-01-01"), "A"), (2, ts("2012-01-01"), "B")],
    )
    got = rows(products.product_financials(t.order_items, t.order_item_refunds, t.products))
    assert got == [("A", 1, 20.0, 12.0, 7.0), ("B", 2, 7.0, 6.0, None)]
    share = rows(products.product_refund_share(t.order_items, t.order_item_refunds, t.products))
    assert share == [(1, "A", 100.0), (2, "B", None)]


# Recoding keeps rows and unmapped values; collation option.
def test_recode(spark):
    pv = table(spark, "website_pageviews", [
        pageview(1, "2012-01-01", 1, "/the-original-mr-fuzzy"), pageview(2, "2012-01-01", 1, "/home"),
        pageview(3, "2012-01-01", 2, "/Cart"), pageview(4, "2012-01-01", 2, "/cart"),
    ])
    out = prep.recode(pv, "pageview_url", "pageview_url", prep.PRODUCT_URLS)
    assert out.count() == 4
    assert rows(out, "website_pageview_id", "pageview_url") == [
        (1, "/high-score-hoodie"), (2, "/home"), (3, "/Cart"), (4, "/cart")]
    ci = prep.recode(pv, "pageview_url", "pageview_url", {"/cart": "/basket"}, collation="UTF8_LCASE")
    assert rows(ci, "website_pageview_id", "pageview_url") == [
        (1, "/the-original-mr-fuzzy"), (2, "/home"), (3, "/basket"), (4, "/basket")]
    prods = table(spark, "products", [(1, ts("2012-01-01"), "The Original Mr. Fuzzy"), (9, ts("2012-01-01"), "X")])
    named = prep.recode(prods, "product_id", "product_name", prep.PRODUCT_NAMES)
    assert rows(named, "product_id", "product_name") == [(1, "High Score Hoodie"), (9, "X")]


def test_first_standalone_order(spark):
    t = tables(
        spark,
        orders=[order(1, "2013-01-10", 1, 5, items=2, product=1), order(2, "2013-01-20", 1, 5, items=1, product=1),
                order(3, "2013-03-01", 2, 5, items=1, product=2)],
        products=[(1, ts("2013-01-01 08:00:00"), "A"), (2, ts("2013-02-01"), "B")],
    )
    assert rows(products.first_standalone_order(t.orders, t.products), "product_id", "days_until_standalone_order") == [
        (1, 19), (2, 28)]


@pytest.mark.parametrize("grain,expected", [
    ("year", [(2024,)]), ("quarter", [(2024, 1)]), ("month", [(2024, 1)]),
    ("week", [("2024-01-01",)]), ("day", [("2024-01-07",)]),
])
def test_grain_keys(spark, grain, expected):
    from shoplens.functions.measures import grain_columns

    df = spark.createDataFrame([(ts("2024-01-07 23:59:59"),)], "t timestamp_ntz")
    assert [tuple(r) for r in df.select(*grain_columns("t", grain)).collect()] == expected


def test_money_stays_exact(spark):
    o = table(spark, "orders", [order(i, "2013-01-01", i, "0.10") for i in range(1, 11)])
    (row,) = financials.period_inflow(o).collect()
    assert row.revenue == 1.0 and row.aov == 0.1
    assert d(row.revenue) == d("1.0")


def test_inspect_limits_rows(spark):
    o = table(spark, "orders", [order(i, "2013-01-01", i, 1) for i in range(1, 31)])
    assert prep.inspect(o, 5).count() == 5
    assert prep.inspect(o).count() == 20
