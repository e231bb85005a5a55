"""Shop tables where one key holds a third of the rows: one customer has a
third of all orders, one order a third of all items and refunds, one
product a third of all items, one session a third of all pageviews and
web orders. Built with spark.range and hash expressions (JVM-side), so the
same generator scales to any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens.sources.tables import ShopTables

URLS = [f"/{t}-{k}" for t in ("view", "click", "signup", "error", "purchase") for k in range(4)]
HOT_ORDER = 3  # order_id of order row 0
HOT_SESSION = 0


def _h(salt: int, mod: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(mod))


def _money(salt: int, lo_cents: int, span: int) -> Column:
    return ((F.lit(lo_cents) + _h(salt, span)) / 100).cast("decimal(12,2)")


def skewed_tables(spark, scale: int = 1) -> ShopTables:
    n_o, n_i, n_s, n_p, n_w = 30000 * scale, 60000 * scale, 20000 * scale, 120000 * scale, 6000 * scale
    day = lambda salt, span, start: F.timestamp_add("SECOND", _h(salt, span * 86400),
                                                    F.lit(start).cast("timestamp_ntz"))
    hot = F.col("id") % 3 == 0

    orders = spark.range(n_o).select(
        (F.col("id") * 7 + 3).alias("order_id"),
        day(1, 1400, "2012-01-01").alias("created_at"),
        F.lit(None).cast("bigint").alias("website_session_id"),
        F.when(hot, F.lit(1)).otherwise(2 + _h(2, 5000)).cast("bigint").alias("user_id"),
        F.when(F.col("id") % 3 == 1, F.lit(1)).otherwise(1 + _h(3, 50)).cast("bigint").alias("primary_product_id"),
        (1 + _h(4, 3)).cast("int").alias("items_purchased"),
        _money(5, 500, 50000).alias("price_usd"),
        (_money(5, 500, 50000) * F.lit(0.6).cast("decimal(4,2)")).cast("decimal(18,4)").alias("cogs_usd"),
    )
    item_order = F.when(hot, F.lit(HOT_ORDER)).otherwise(_h(6, n_o) * 7 + 3)
    items = spark.range(n_i).select(
        F.col("id").alias("order_item_id"),
        day(7, 1400, "2012-01-01").alias("created_at"),
        item_order.cast("bigint").alias("order_id"),
        F.when(F.col("id") % 3 == 1, F.lit(1)).otherwise(1 + _h(8, 50)).cast("bigint").alias("product_id"),
        F.when(_h(9, 3) == 0, 1).otherwise(0).alias("is_primary_item"),
        _money(10, 100, 20000).alias("price_usd"),
        (_money(10, 100, 20000) * F.lit(0.55).cast("decimal(4,2)")).cast("decimal(18,4)").alias("cogs_usd"),
    )
    refunds = spark.range(n_i).where(_h(11, 4) == 0).select(
        F.col("id").alias("order_item_refund_id"),
        day(12, 1400, "2012-02-01").alias("created_at"),
        F.col("id").alias("order_item_id"),
        item_order.cast("bigint").alias("order_id"),
        (_money(10, 100, 20000) * F.lit(1.07).cast("decimal(4,2)")).cast("decimal(18,4)").alias("refund_amount_usd"),
    )
    products = spark.range(1, 51).select(
        F.col("id").alias("product_id"), day(13, 300, "2011-06-01").alias("created_at"),
        F.concat(F.lit("product "), F.col("id").cast("string")).alias("product_name"))
    paid = _h(14, 3) != 0
    sessions = spark.range(n_s).select(
        F.col("id").alias("website_session_id"),
        day(15, 29, "2024-01-01").alias("created_at"),
        (1 + _h(16, 3000)).cast("bigint").alias("user_id"),
        F.when(paid, F.when(_h(17, 3) == 0, "src_b").otherwise("src_a")).alias("utm_source"),
        F.when(paid, F.concat(F.lit("camp_"), _h(18, 3).cast("string"))).alias("utm_campaign"),
        F.when(paid, F.concat(F.lit("ad_"), _h(19, 2).cast("string"))).alias("utm_content"),
        F.when(_h(20, 3) == 0, "mobile").otherwise("desktop").alias("device_type"),
    )
    url = F.element_at(F.array(*[F.lit(u) for u in URLS]), (1 + _h(21, len(URLS))).cast("int"))
    pageviews = spark.range(n_p).select(
        F.col("id").alias("website_pageview_id"),
        F.timestamp_add("SECOND", F.col("id") * 20, F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        F.when(hot, F.lit(HOT_SESSION)).otherwise(_h(22, n_s)).cast("bigint").alias("website_session_id"),
        url.alias("pageview_url"),
    )
    web_orders = spark.range(n_w).select(
        (F.col("id") + 10**9).alias("order_id"),
        day(23, 29, "2024-01-01").alias("created_at"),
        F.when(hot, F.lit(HOT_SESSION)).otherwise(_h(24, n_s)).cast("bigint").alias("website_session_id"),
        (1 + _h(25, 3000)).cast("bigint").alias("user_id"),
        F.lit(None).cast("bigint").alias("primary_product_id"),
        F.lit(None).cast("int").alias("items_purchased"),
        _money(26, 500, 8000).alias("price_usd"),
        F.lit(None).cast("decimal(18,4)").alias("cogs_usd"),
    )
    return ShopTables(orders=orders, order_items=items, order_item_refunds=refunds, products=products,
                      website_sessions=sessions, website_pageviews=pageviews, web_orders=web_orders)
