"""Collated keys, updates in order, versions of a published copy, a kept-up session summary."""

from __future__ import annotations

import random
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from shop_rows import table, tables, ts
from shoplens.functions.collation import collate_tables, collated, other_spellings
from shoplens.operators import prep, website
from shoplens.sources import versions
from shoplens.sources.tables import SCHEMAS, read_catalog, read_published

VIEWS = [(1, ts("2012-01-01"), 1, "/Cart"), (2, ts("2012-01-02"), 1, "/cart"), (3, ts("2012-01-03"), 2, "/cárt"),
         (4, ts("2012-01-04"), 2, "/home"), (5, ts("2012-01-05"), 3, None), (6, ts("2012-01-06"), 3, "/HOME"), (7, ts("2012-01-07"), 3, "/carts")]
SESSIONS = [(1, ts("2012-01-01"), 1, "Google", "nónbrand", None, "mobile"), (2, ts("2012-01-01"), 2, "google", "nonbrand", None, "Mobile"),
            (3, ts("2012-01-01"), 3, "goögle", None, None, "desktop"), (4, ts("2012-01-01"), 4, None, None, None, "desktop")]


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def shop(spark):
    return tables(spark, website_pageviews=VIEWS, website_sessions=SESSIONS)


def test_collated_urls_and_campaigns_are_one_key(shop):
    t = collate_tables(shop, pages=["/cart"])
    assert found(website.url_pageviews(t.website_pageviews)) == found_list([("/cart", 3), ("/HOME", 2), ("/carts", 1), (None, 1)])
    assert found(website.traffic_tuples(t.website_sessions)) == found_list(
        [("Google", "nonbrand", None, "Mobile"), ("Google", None, None, "desktop"), (None, None, None, "desktop")])
    assert found(website.paid_sources(t.website_sessions)) == [("Google", 3)]
    assert t.website_pageviews.count() == len(VIEWS) and t.website_pageviews.columns == SCHEMAS["website_pageviews"]


def found_list(rows):
    return sorted(rows, key=repr)


def test_representatives_are_preferred_or_least(shop):
    urls = {r[0]: r[1] for r in other_spellings(shop.website_pageviews, "pageview_url", prefer=["/CaRT"]).collect()}
    assert urls == {"/Cart": "/CaRT", "/cart": "/CaRT", "/cárt": "/CaRT", "/home": "/HOME"}
    assert found(collated(shop.website_pageviews, "pageview_url", "UTF8_LCASE"), "pageview_url") == found_list(
        [("/Cart",), ("/Cart",), ("/cárt",), ("/HOME",), ("/HOME",), ("/carts",), (None,)])


def test_the_collated_summary_agrees_with_its_pageviews(shop):
    t = collate_tables(replace(shop, session_summary=website.session_summary(shop.website_pageviews)), pages=["/cart"])
    a = website.entry_pages(t.website_pageviews, t.session_summary)
    assert found(a) == found(website.entry_pages(t.website_pageviews)) and a.count() == 2


def literal_updates(rows, updates, same, fold):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for old, new in updates:
        test = f"lower(strip_accents({'v' if same else 'k'})) = lower(strip_accents(?))" if fold else f"{'v' if same else 'k'} = ?"
        con.execute(f"UPDATE t SET v = ? WHERE {test}", [new, old])
    return sorted(con.execute("SELECT k, v FROM t").fetchall(), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_updates_in_order_equal_the_statements(spark, seed):
    rng = random.Random(seed)
    values = ["a", "b", "c", "d", "A", "á", "B", None]
    rows = [(rng.choice(values), rng.choice(values)) for _ in range(60)]
    updates = [(rng.choice(values), rng.choice(values)) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k string, v string")
    for same in (True, False):
        for collation in (None, "UNICODE_CI_AI"):
            got = prep.apply_updates(df, "v" if same else "k", "v", updates, collation)
            assert found(got) == literal_updates(rows, updates, same, collation is not None), (same, collation, updates)


def test_chained_and_swapped_values():
    assert prep.compose_updates([("a", "b"), ("b", "c")], True) == {"a": "c", "b": "c"}
    assert prep.compose_updates([("a", "x"), ("b", "a"), ("x", "b")], True) == {"a": "b", "b": "a", "x": "b"}
    assert prep.compose_updates([(1, "x"), (1, "y"), (None, "z")], False) == {1: "y"}
    assert prep.compose_updates([], True) == {}


def test_a_key_mapped_twice_is_an_error(spark, shop):
    views = shop.website_pageviews
    twice = spark.createDataFrame([("/cart", "/x"), ("/cart", "/y")], "k string, v string")
    with pytest.raises(Exception, match="mapped twice"):
        prep.recode(views, "pageview_url", "pageview_url", twice).collect()
    equal = spark.createDataFrame([("/cart", "/x"), ("/CÁRT", "/x")], "k string, v string")
    assert prep.recode(views, "pageview_url", "pageview_url", equal).count() == len(VIEWS)
    with pytest.raises(Exception, match="mapped twice"):
        prep.recode(views, "pageview_url", "pageview_url", equal, "UNICODE_CI_AI").collect()
    nulls = spark.createDataFrame([(None, "/x"), (None, "/y"), ("/cart", None)], "k string, v string")
    assert found(prep.recode(views, "pageview_url", "pageview_url", nulls), "pageview_url").count((None,)) == 2


def small_shop(spark, n):
    return tables(spark, website_pageviews=VIEWS[:n], website_sessions=SESSIONS)


def test_a_publish_that_dies_leaves_the_old_copy(spark, tmp_path):
    root = str(tmp_path / "shop")
    prep.publish(small_shop(spark, 4), root)
    before = found(read_published(spark, root).website_pageviews)
    broken = small_shop(spark, 7)
    # Six tables are written, the last one fails.
    last = broken.web_orders.unionByName(spark.range(1).selectExpr(*[
        f"cast(raise_error('executor lost') as {f.dataType.simpleString()}) as {f.name}" if f.name == "price_usd"
        else f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in broken.web_orders.schema]))
    with pytest.raises(Exception, match="executor lost"):
        prep.publish(replace(broken, web_orders=last), root)
    now = read_published(spark, root)
    assert found(now.website_pageviews) == before and now.session_summary is not None
    assert versions.latest(spark, root)["version"] == 1
    prep.publish(small_shop(spark, 7), root)
    assert read_published(spark, root).website_pageviews.count() == 7


def test_unfinished_and_competing_commits(spark, tmp_path):
    root = str(tmp_path / "shop")
    prep.publish(small_shop(spark, 3), root)
    (tmp_path / "shop" / "_commits" / f"{2:020d}.json").write_text('{"tables": ')  # its writer died
    assert read_published(spark, root).website_pageviews.count() == 3
    with pytest.raises(versions.ConcurrentChange):
        versions.commit(spark, root, {"tables": {}}, after=0)
    prep.publish(small_shop(spark, 5), root)
    assert versions.latest(spark, root)["version"] == 3
    assert read_published(spark, root).website_pageviews.count() == 5
    assert versions.latest(spark, str(tmp_path / "nothing")) is None


def test_appended_pageviews_reach_the_summary_without_a_rebuild(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "shop")
    prep.publish(small_shop(spark, 3), root)
    seen = []
    real = website.session_summary
    monkeypatch.setattr(website, "session_summary", lambda views: seen.append(views.count()) or real(views))
    earlier = (0, ts("2011-12-31"), 2, "/early")
    prep.append_pageviews(spark, root, table(spark, "website_pageviews", VIEWS[3:] + [earlier]))
    assert seen == [5]  # the new rows only
    t = read_published(spark, root)
    assert t.website_pageviews.count() == 8 and t.session_summary is not None
    assert found(t.session_summary) == found(real(t.website_pageviews))
    for report in (website.entry_pages, website.landing_pages, website.landing_bounce_rate, website.session_landing):
        assert found(report(t.website_pageviews, t.session_summary)) == found(report(t.website_pageviews))
    with pytest.raises(ValueError, match="nothing is published"):
        prep.append_pageviews(spark, str(tmp_path / "other"), t.website_pageviews)


def test_a_stale_summary_is_not_believed(spark, tmp_path):
    root = str(tmp_path / "shop")
    prep.publish(small_shop(spark, 3), root)
    folder = versions.latest(spark, root)["tables"]["website_pageviews"][0]
    table(spark, "website_pageviews", VIEWS[3:]).write.mode("append").parquet(folder)  # behind the dataset's back
    t = read_published(spark, root)
    assert t.session_summary is None and t.summary().count() == 3
    prep.append_pageviews(spark, root, table(spark, "website_pageviews", [(9, ts("2012-02-01"), 9, "/x")]))
    t = read_published(spark, root)
    assert found(t.session_summary) == found(website.session_summary(t.website_pageviews))


def test_a_stale_summary_of_a_catalog_is_not_believed(spark, tmp_path):
    prep.publish(small_shop(spark, 3), str(tmp_path / "shop"), catalog_prefix="stale_", buckets=2)
    assert read_catalog(spark, prefix="stale_").session_summary is not None
    table(spark, "website_pageviews", VIEWS[3:]).write.mode("append").format("parquet").saveAsTable("stale_website_pageviews")
    t = read_catalog(spark, prefix="stale_")
    assert t.session_summary is None
    assert found(website.entry_pages(t.website_pageviews, t.session_summary)) == found(website.entry_pages(t.website_pageviews))
    assert t.website_pageviews.agg(F.count("website_pageview_id")).first()[0] == 6 + 1
