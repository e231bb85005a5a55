"""Driver contract: entry() smoke, stable schema, published tables."""

from __future__ import annotations

import pytest

from places import SF_SMOKE

import __spark_entry__ as entry
from shoplens.operators.prep import published_counts
from shoplens.sources.fixture import fixture_tables, map_fixture
from shoplens.sources.tables import SCHEMAS


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == [
        "year", "unique_customers", "qty_sold", "qty_refunds", "refund_rate", "revenue_usd",
        "refund_volume_usd", "total_cogs", "total_refund_losses", "margin",
        "margin_less_refund_losses", "aov",
    ]
    assert [r.year for r in rows] == sorted(r.year for r in rows)


def test_schema_is_stable(spark):
    a = entry.entry(spark).schema
    b = entry.entry(spark).schema
    assert a == b


def test_published_tables_match_mapping(spark, tmp_path):
    mapped = map_fixture(spark, SF_SMOKE)
    published = fixture_tables(spark, SF_SMOKE)
    for name, df in published.items():
        assert df.columns == SCHEMAS[name]
        mapped_types = [(f.name, f.dataType) for f in getattr(mapped, name).select(*SCHEMAS[name]).schema]
        assert [(f.name, f.dataType) for f in df.schema] == mapped_types
    from shoplens.operators.prep import publish

    root = str(tmp_path / "pub")
    publish(mapped, root)
    for name, (src, back) in published_counts(mapped, root).items():
        assert src == back, name


def test_fixture_tables_fall_back_to_plain_parquet(spark, monkeypatch):
    """When the catalog refuses the bucketed tables, the same reports run
    over a plain Parquet copy and give the same rows."""
    from pyspark.errors import AnalysisException

    import shoplens.operators.prep as prep_mod
    from shoplens.plans.reports import REPORTS
    from shoplens.sources import fixture

    def no_catalog(name, df, root, catalog_prefix, buckets):
        raise AnalysisException("catalog unavailable")

    bucketed = fixture_tables(spark, SF_SMOKE)
    assert bucketed.summary() is bucketed.session_summary
    monkeypatch.setattr(prep_mod, "publish_table", no_catalog)
    monkeypatch.setattr(fixture, "_PUBLISHED", {})
    monkeypatch.setattr(fixture, "MAPPING_VERSION", "fallback-test")
    plain = fixture_tables(spark, SF_SMOKE)
    from plan_audit import plan_text

    assert "Bucketed: true" not in plan_text(plain.order_items)
    for name in ["financials_annual", "product_lifetime", "funnel", "landing_bounce_rate"]:
        a = sorted(map(tuple, REPORTS[name](bucketed).collect()))
        b = sorted(map(tuple, REPORTS[name](plain).collect()))
        assert a == b, name


def test_publish_errors_surface(spark, monkeypatch):
    """Only the catalog's refusal has another way; a full disk must not start a second write."""
    import shoplens.operators.prep as prep_mod
    from shoplens.sources import fixture

    def full(*args, **kwargs):
        raise OSError("no space left on device")

    monkeypatch.setattr(prep_mod, "publish_table", full)
    monkeypatch.setattr(fixture, "_PUBLISHED", {})
    monkeypatch.setattr(fixture, "MAPPING_VERSION", "error-test")
    with pytest.raises(OSError, match="no space left"):
        fixture_tables(spark, SF_SMOKE).orders


def test_tables_are_staged_when_first_read(spark, monkeypatch):
    """A report stages the tables it reads and what those are made of, nothing else, and once."""
    import os

    from shoplens.plans.reports import REPORTS
    from shoplens.sources import fixture

    monkeypatch.setattr(fixture, "_PUBLISHED", {})
    monkeypatch.setattr(fixture, "MAPPING_VERSION", "demand-test")
    t = fixture_tables(spark, SF_SMOKE)
    (published,) = fixture._PUBLISHED.values()
    folder = published.root.removeprefix("file:")
    assert published.places == {} and not os.path.exists(folder)
    last = REPORTS["last_order"](t).collect()
    assert published.places == {"web_orders": "catalog"}
    assert os.listdir(folder) == ["bucketed"]  # no line item was numbered
    REPORTS["landing_bounce_rate"](t).collect()
    assert set(published.places) == {"web_orders", "website_pageviews", "session_summary"}
    REPORTS["inflow_annual"](fixture_tables(spark, SF_SMOKE)).collect()
    assert set(published.places) == {"web_orders", "website_pageviews", "session_summary", "orders"}
    assert sorted(os.listdir(f"{folder}/_stage")) == ["items_ranged", "items_wide"]
    assert REPORTS["last_order"](fixture_tables(spark, SF_SMOKE)).collect() == last


def test_bucket_count_follows_input_size(spark):
    from shoplens.sources.fixture import bucket_count

    assert bucket_count(spark, SF_SMOKE) == spark.sparkContext.defaultParallelism
    # No cap by the shuffle partitions.
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucket_count(spark, SF_SMOKE, bytes_per_bucket=1 << 10) > 10 * cap


def test_shared_folder_is_the_sessions_checkpoint_dir(spark):
    from shoplens.sources.fixture import shared_folder

    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_split_item_numbering_equals_the_window(spark, tmp_path):
    """The skew-safe numbering (range partitions + boundary offsets) gives
    exactly ROW_NUMBER() per order, also for an order holding a third of
    all line items."""
    from pyspark.sql import functions as F

    from shoplens.sources.fixture import ITEM_ORDER, number_items

    def stage(name, df):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    hot = li.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey")))
    for df, parts in [(li, 8), (hot, 16)]:
        a = number_items(df).select("l_orderkey", *ITEM_ORDER, "seq")
        b = number_items(df, stage, parts).select("l_orderkey", *ITEM_ORDER, "seq")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_item_keys_of_a_large_order_are_unique(spark, tmp_path):
    """One order of thousands of items: its mapped item keys collide with none, and its products add up."""
    import shutil

    from pyspark.sql import functions as F

    from shoplens.operators import products
    from shoplens.sources.fixture import map_fixture

    for name in ("orders", "part", "events"):
        shutil.copy(f"{SF_SMOKE}/{name}.parquet", tmp_path / f"{name}.parquet")
    li = spark.read.parquet(f"{SF_SMOKE}/lineitem.parquet")
    li.withColumn("l_orderkey", F.when(F.col("l_linenumber") <= 6, F.lit(7)).otherwise(F.col("l_orderkey"))).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    t = map_fixture(spark, str(tmp_path))
    items = t.order_items
    assert items.where("order_id = 7").count() > 4000
    assert items.count() == items.select("order_item_id").distinct().count()
    got = products.product_financials(items, t.order_item_refunds, t.products, None)
    want = li.agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)"))).first()[0]
    assert abs(got.agg(F.sum("revenue")).first()[0] - float(want)) < 0.01 * float(want) ** 0.5
