"""Claimed keys, coincident times, all grains in one report: hand-written rows."""

from __future__ import annotations

import pytest
from plan_audit import plan_text
from shop_rows import d, item, order, pageview, refund, session, tables, ts
from test_hand_rows import rows

from shoplens.operators import audits, prep, products, website
from shoplens.sources.tables import CLAIMED_KEYS, SCHEMAS, read_published

#: Order 1 is refunded twice, order 2 first at the time of order 1's second refund, order 3 without a time, order 4 twice at one time.
REFUNDS = [
    refund(10, "2014-05-01", 10, 1, 5), refund(11, "2014-05-03", 11, 1, 6), refund(12, "2014-05-04", 12, 1, 7),
    refund(20, "2014-05-03", 20, 2, 8),
    (30, None, 30, 3, d(9)), (31, None, 31, 3, d(9)),
    refund(40, "2014-05-06", 40, 4, 1), refund(41, "2014-05-06", 41, 4, 2),
]


def test_refunds_by_time_and_by_key(spark):
    r = tables(spark, order_item_refunds=REFUNDS).order_item_refunds
    by_key = {x[0] for x in rows(audits.repeat_refund_items(r), "order_item_refund_id")}
    by_time = {x[0] for x in rows(audits.repeat_refund_items_by_time(r), "order_item_refund_id")}
    assert by_key == {11, 12, 31, 41}
    assert by_time == {12, 30, 31}
    told = rows(audits.coincident_refunds(r))
    assert told == [
        (11, ts("2014-05-03"), 1, 1, "hidden"), (30, None, 3, 0, "undated"), (41, ts("2014-05-06"), 4, 1, "hidden")]
    assert {x[0] for x in told} == by_key ^ by_time


def test_refunds_by_time_of_an_empty_table(spark):
    r = tables(spark).order_item_refunds
    assert rows(audits.repeat_refund_items_by_time(r)) == rows(audits.coincident_refunds(r)) == []


def test_one_time_shared_by_most_refunds(spark):
    """First refunds of many orders at one instant are one row of times; every repeat at it is hidden."""
    many = [refund(i * 10, "2014-01-01", i * 10, i, 1) for i in range(1, 400)]
    again = [refund(i * 10 + 1, "2014-01-01", i * 10 + 1, i, 1) for i in range(1, 400, 3)]
    r = tables(spark, order_item_refunds=many + again).order_item_refunds
    assert rows(audits.repeat_refund_items_by_time(r)) == []
    told = rows(audits.coincident_refunds(r), "order_item_refund_id", "orders_first_refunded_then")
    assert told == sorted((x[0], 399) for x in again)


def test_landing_status_rows_counts_coincident_pageviews(spark):
    views = [
        pageview(1, "2015-03-05 10:00:00", 1, "/home"), pageview(2, "2015-03-05 10:00:00", 2, "/cart"),
        pageview(3, "2015-03-05 10:00:00", 3, "/home"), pageview(4, "2015-02-01 10:00:00", 4, "/lander-1"),
        pageview(5, "2015-02-03 10:00:00", 4, "/cart"), (6, None, 6, "/lander-2"),
    ]
    t = tables(spark, website_pageviews=views)
    pages = ["/home", "/lander-1", "/lander-2", "/lander-9"]
    assert rows(website.landing_status_rows(t.website_pageviews, urls=pages)) == [
        ("/home", ts("2015-03-05 10:00:00"), "ACTIVE", 3), ("/lander-1", ts("2015-02-01 10:00:00"), "INACTIVE", 1),
        ("/lander-2", None, "INACTIVE", 1)]
    assert rows(website.landing_status_rows(t.website_pageviews.where("false"), urls=pages)) == []


def test_key_audit_counts_missing_and_repeated_keys(spark):
    t = tables(
        spark, orders=[order(1, "2013-01-01", 1, 10), order(1, "2013-01-02", 1, 10), order(2, "2013-01-02", 1, 10)],
        website_sessions=[session(1, "2013-01-01", 1), session(None, "2013-01-01", 2), session(None, "2013-01-01", 3)])
    got = {r[0]: r[1:] for r in rows(audits.key_audit(t))}
    assert set(got) == set(CLAIMED_KEYS)
    assert got["orders"] == ("order_id", 3, 0, 2, 1)
    assert got["website_sessions"] == ("website_session_id", 3, 2, 1, 0)
    assert got["products"] == ("product_id", 0, 0, 0, 0)


def test_broken_keys_are_not_published(spark, tmp_path):
    root = str(tmp_path / "shop")
    good = tables(spark, order_item_refunds=REFUNDS)
    prep.publish(good, root, check_keys=True)
    bad = tables(spark, order_item_refunds=[*REFUNDS, refund(10, "2014-06-01", 11, 1, 5)])
    with pytest.raises(ValueError, match="order_item_refunds.order_item_refund_id: 0 rows without a key, 1 repeated"):
        prep.publish(bad, root, check_keys=True)
    assert read_published(spark, root).order_item_refunds.count() == len(REFUNDS)  # the old copy stays
    with pytest.raises(ValueError, match="order_item_refunds"):
        prep.publish(bad, root, catalog_prefix="broken_", check_keys=True)
    assert not any(spark.catalog.tableExists(f"broken_{name}") for name in SCHEMAS)


ITEMS = [
    item(1, "2013-01-05", 1, 1, 10, 4), item(2, "2013-02-05", 2, 1, 20, 5), item(3, "2013-05-05", 3, 1, 30, 6),
    item(4, "2014-05-05", 4, 1, 40, 7), item(5, "2014-05-06", 5, 2, 50, 8), (6, None, 6, 2, 1, d(60), d(9)),
]


def test_all_grains_equal_the_single_reports(spark):
    refunds = [refund(1, "2013-02-01", 1, 1, 3), refund(2, "2013-02-01", 1, 1, 2), refund(6, "2014-02-01", 6, 6, 1)]
    t = tables(spark, order_items=ITEMS, order_item_refunds=refunds, products=[(1, ts("2012-01-01"), "hoodie")])
    args = (t.order_items, t.order_item_refunds, t.products)
    every = products.product_financials_by_grains(*args)
    columns = ["product_name", "product_id", "revenue", "margin", "refund_volume"]
    for grain, periods in products.GRAIN_SETS.items():
        one = products.product_financials(*args, None if grain == "lifetime" else grain)
        assert rows(every.where(every.grain == grain), *columns, *periods) == rows(one, *columns, *periods), grain
        others = [c for c in ("year", "quarter", "month") if c not in periods]
        assert all(value is None for row in (rows(every.where(every.grain == grain), *others) if others else []) for value in row), grain
    assert rows(every.where("grain = 'year'"), "product_id", "year", "revenue", "margin", "refund_volume") == [
        (1, 2013, 70.0, 51.0, 5.0), (1, 2014, 40.0, 33.0, None), (2, 2014, 50.0, 42.0, None), (2, None, 60.0, 51.0, 1.0)]
    assert {r[0] for r in rows(products.product_financials_by_grains(*args, grains=["month", "lifetime"]), "grain")} == {"month", "lifetime"}
    with pytest.raises(ValueError, match="grains"):
        products.product_financials_by_grains(*args, grains=["decade"])


def test_all_grains_join_items_and_refunds_once(spark):
    t = tables(spark, order_items=ITEMS, order_item_refunds=REFUNDS)
    text = plan_text(products.product_financials_by_grains(t.order_items, t.order_item_refunds, t.products), "formatted")
    assert "Expand" in text
    joins = [line for line in text.splitlines() if "Left keys" in line and "order_item_id" in line]
    assert len(joins) == 1, joins
