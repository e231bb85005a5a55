"""Physical plans: no cartesian products, no Python workers, pruned and
filtered scans."""

from __future__ import annotations

import re

import pytest
from places import SF_SMOKE
from plan_audit import plan_text

import __spark_entry__ as entry
from shoplens.plans.reports import REPORTS

NAMES = sorted(REPORTS)
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_no_python(spark, name):
    text = plan_text(entry.queries()[name](spark, SF_SMOKE), "extended")
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"


def _read_schemas(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_financials_scan_prunes_columns(spark):
    text = plan_text(entry.queries()["inflow_annual"](spark, SF_SMOKE))
    (cols,) = _read_schemas(text)
    assert cols == {"created_at", "user_id", "items_purchased", "price_usd", "cogs_usd"}


@pytest.mark.parametrize("name,needle", [
    ("addon_items", "GreaterThan(items_purchased,1)"),
    ("first_standalone_order", "EqualTo(items_purchased,1)"),
    ("product_bounce_rate", "In(pageview_url"),
    ("paid_sources", "IsNotNull(utm_source)"),
])
def test_filters_reach_the_scan(spark, name, needle):
    text = plan_text(entry.queries()[name](spark, SF_SMOKE))
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", text))
    assert needle in pushed, pushed


def test_sequence_uses_partial_top_k(spark):
    text = plan_text(entry.queries()["order_sequence"](spark, SF_SMOKE))
    assert text.count("WindowGroupLimit") >= 2  # partial before the shuffle, final after


def test_session_summary_aggregates_partially(spark):
    from shoplens.operators.website import session_summary
    from shoplens.sources.fixture import fixture_tables

    t = fixture_tables(spark, SF_SMOKE)
    text = plan_text(session_summary(t.website_pageviews))
    assert "partial_min_by" in text and "partial_count" in text
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_landing_reports_scan_the_published_summary(spark):
    for name in ["landing_bounce_rate", "session_landing", "entry_pages", "pageviews_per_session"]:
        text = plan_text(entry.queries()[name](spark, SF_SMOKE))
        assert "session_summary" in text, name
        assert "website_pageviews" not in text, name


def test_bucketed_tables_skip_join_key_shuffles(spark):
    """Tables with unique join keys are bucketed on them: the items/refunds join
    runs without a shuffle. Pageviews and web orders, where one session may
    hold many rows, are not bucketed."""
    for name, key in [("product_lifetime", "order_item_id"), ("product_quarterly", "order_item_id")]:
        text = plan_text(entry.queries()[name](spark, SF_SMOKE))
        assert "Bucketed: true" in text, name
        assert f"hashpartitioning({key}" not in text, name
