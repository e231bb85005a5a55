"""What queries write, shuffle and hold as their tables grow: hot orders, buckets, copies that are not needed."""

from __future__ import annotations

import datetime as dt
import os
import re
import time

import pytest
from plan_audit import plan_text
from shop_rows import d, item, refund, tables

from shoplens.operators import products
from shoplens.plans.reports import REPORTS
from shoplens.sources import fixture
from shoplens.sources import tables as sources

DAY = dt.datetime(2000, 1, 1)
LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def shop(spark, tmp_path):
    """Orders of 1 to 60 items, one of them twice, one unknown, and items without an order."""
    sizes = {1: 1, 2: 60, 3: 5, 4: 40, 9: 3, None: 50}
    rows = [(o, 1 + (i * 7 + n) % 11, i % 3, 1 + i % 4, float(i), 10.0 + i, 0.05, 0.02, "RAN"[i % 3], "O", DAY + dt.timedelta(days=i))
            for o, n in sizes.items() for i in range(n)]
    orders = [(o, o % 3, "O", 100.0 * o, DAY + dt.timedelta(days=o), "1") for o in (1, 2, 3, 3, 4, 5)]
    parts = [(p, f"part {p}", "b", "t", 1, 1.0) for p in range(1, 13)]
    events = [(i, dt.datetime(2024, 1, 1 + i % 3), i % 4, ("view", "purchase")[i % 2], 5.0, '{"k": %d}' % i) for i in range(30)]
    for name, data, schema in (("lineitem", rows, LINEITEM), ("orders", orders, ORDERS), ("part", parts, PART), ("events", events, EVENTS)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _published(spark, shop):
    fixture.fixture_tables(spark, shop)
    return fixture._PUBLISHED[(fixture._app_id(spark), fixture._fingerprint(shop))]


def _same(a, b):
    assert a.columns == b.columns
    assert (a.exceptAll(b).collect(), b.exceptAll(a).collect()) == ([], [])


def test_hot_orders_are_found(spark, shop):
    lineitem = spark.read.parquet(f"{shop}/lineitem.parquet")
    assert sorted(fixture.hot_orders(lineitem, 40), key=str) == [2, None]
    assert sorted(fixture.hot_orders(lineitem, 39, groups=1), key=str) == [2, 4, None]
    assert fixture.hot_orders(lineitem, 60) == fixture.hot_orders(lineitem) == []


@pytest.mark.parametrize("hot", [30, 1_000_000])
def test_only_hot_orders_are_numbered_by_ranges(spark, shop, hot, monkeypatch):
    """Items and all that is made of them are the same with and without hot orders, missing order keys among them."""
    monkeypatch.setattr(fixture, "HOT_ORDER", hot)
    found, plain = fixture.fixture_tables(spark, shop), fixture.map_fixture(spark, shop)
    for name in ("order_items", "order_item_refunds", "orders", "products"):
        _same(getattr(found, name), getattr(plain, name))
    ranged = spark.read.parquet(f"{_published(spark, shop).root}/_stage/items_ranged")
    assert ranged.count() == (150 if hot == 30 else 0)


def test_key_audit_writes_no_copies(spark, shop):
    got = REPORTS["claimed_keys"](fixture.fixture_tables(spark, shop)).collect()
    published = _published(spark, shop)
    assert not published.places
    full = REPORTS["claimed_keys"](fixture.map_fixture(spark, shop)).collect()
    assert sorted(got) == sorted(full)
    assert {r.table_name: r.repeated_keys for r in got}["orders"] == 1
    # Written tables are audited as written, replaced ones as replaced.
    t = fixture.fixture_tables(spark, shop)
    t.orders.count()
    assert sorted(REPORTS["claimed_keys"](t).collect()) == sorted(full)
    changed = REPORTS["claimed_keys"](t.with_tables(orders=t.orders.limit(0))).collect()
    assert {r.table_name: r.row_count for r in changed}["orders"] == 0


@pytest.mark.parametrize("hot", [30, 1_000_000])
def test_product_names_need_no_item_numbers(spark, shop, hot, monkeypatch):
    monkeypatch.setattr(fixture, "HOT_ORDER", hot)
    t = fixture.fixture_tables(spark, shop)
    _same(REPORTS["recode_product_names"](t), REPORTS["recode_product_names"](fixture.map_fixture(spark, shop)))
    assert not os.path.exists(f"{_published(spark, shop).root}/_stage")


def test_buckets_follow_the_input(spark, shop, monkeypatch):
    """A gigabyte of input goes to buckets of a few megabytes, not to a dozen of 128."""
    monkeypatch.setattr(fixture, "table_bytes", lambda df: 1 << 28)
    assert fixture.bucket_count(spark, shop) >= 64


def test_all_grains_shuffle_once(spark):
    t = tables(spark, order_items=[item(1, "2013-01-05", 1, 1, 10, 4)], order_item_refunds=[refund(1, "2013-02-01", 1, 1, 3)])
    text = plan_text(products.product_financials_by_grains(t.order_items, t.order_item_refunds, t.products))
    assert len(re.findall(r"hashpartitioning\(product_id#\d+L?, year", text)) == 1


def test_all_grains_are_multiplied_after_the_last_shuffle(spark):
    """What is shuffled is a row per product and month, not one per grain too; names meet it before the rows are multiplied."""
    t = tables(spark, order_items=[item(1, "2013-01-05", 1, 1, 10, 4)], order_item_refunds=[refund(1, "2013-02-01", 1, 1, 3)])
    text = plan_text(products.product_financials_by_grains(t.order_items, t.order_item_refunds, t.products))
    assert 0 < text.index("Expand") < text.index("Exchange")
    assert text.index("Expand") < text.index("Join")


@pytest.mark.parametrize("grains", [("lifetime",), ("year",), ("quarter",), ("month",), ("quarter", "year"), ("month", "year", "month"), tuple(products.GRAIN_SETS)])
def test_grains_add_up_with_repeated_names_and_missing_keys(spark, grains):
    """Several months, quarters and years of products that are known, unknown, missing or named twice; undated items."""
    days = ["2012-12-31", "2013-01-05", "2013-01-06", "2013-03-01", "2013-04-01", "2013-12-31", "2014-01-01"]
    items = [item(10 * p + i, day, 1, p, 10 * p + i, i) for p in (1, 2, 3) for i, day in enumerate(days)]
    items += [(i, day, 1, p, 1, d(i), d(3)) for i, day, p in ((91, None, 1), (92, DAY, None), (93, None, None), (94, None, 1))]
    refunds = [refund(i, "2014-02-01", iid, 1, i) for i, iid in enumerate((10, 10, 13, 25, 91, 93), 1)]
    t = tables(spark, order_items=items, order_item_refunds=refunds, products=[(1, DAY, "a"), (1, DAY, "b"), (2, DAY, None), (None, DAY, "none")])
    args = (t.order_items, t.order_item_refunds, t.products)
    every = products.product_financials_by_grains(*args, grains=grains)
    for grain in dict.fromkeys(grains):
        columns = ["product_name", "product_id", *products.GRAIN_SETS[grain], "revenue", "margin", "refund_volume"]
        one = products.product_financials(*args, None if grain == "lifetime" else grain)
        _same(every.where(every.grain == grain).select(*columns), one.select(*columns))
    assert {r.grain for r in every.select("grain").collect()} == set(grains)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {os.path.basename(f) for f in files.splitlines() if "/shuffle_" in f}


def test_written_copies_leave_no_shuffle_files(spark, shop):
    before, settings = _shuffle_files(spark), {key: spark.conf.get(key, None) for key in fixture.ITEM_SETTINGS}
    t = fixture.fixture_tables(spark, shop)
    t.order_items, t.order_item_refunds, t.products  # each is written
    until = time.monotonic() + 20
    while _shuffle_files(spark) - before and time.monotonic() < until:  # files are removed in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert settings == {key: spark.conf.get(key, None) for key in fixture.ITEM_SETTINGS} and not sources._HELD


def test_item_copies_are_compact(spark, shop):
    fixture.fixture_tables(spark, shop).order_items
    root = _published(spark, shop).root.removeprefix("file:")
    files = [f"{d}/{f}" for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_settings_come_back_after_the_last_block(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), sources.held(spark, {key: "3"}):
        with sources.held(spark, {key: "3"}):
            pass
        assert spark.conf.get(key) == "3"
        1 / 0
    assert spark.conf.get(key) == before
