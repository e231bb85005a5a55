"""Cash-flow financials: money in, refunds out, per period.

Orders and refunds are aggregated separately and joined on the period
key, one row per period on each side, so the join cannot fan out. Both
aggregates are partial (map-side) hash aggregations; the join inputs are
one row per period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.measures import grain_keys, mean, money, ratio, with_grain


def _inflow(orders: DataFrame, grain: str) -> DataFrame:
    keys = grain_keys(grain)
    return with_grain(orders, "created_at", grain).groupBy(*keys).agg(
        F.countDistinct("user_id").alias("unique_customers"),
        F.sum("items_purchased").cast("bigint").alias("qty_sold"),
        F.sum("price_usd").alias("revenue"),
        F.sum("cogs_usd").alias("total_cogs"),
        F.sum(F.col("price_usd") - F.col("cogs_usd")).alias("margin"),
        mean("price_usd").alias("aov"),
    )


def _outflow(refunds: DataFrame, grain: str) -> DataFrame:
    keys = grain_keys(grain)
    # order_item_refund_id is the key of the refunds table: COUNT equals COUNT(DISTINCT).
    return with_grain(refunds, "created_at", grain).groupBy(*keys).agg(
        F.count("order_item_refund_id").alias("qty_refunds"),
        F.sum("refund_amount_usd").alias("refund_volume_usd"),
    )


def _yq(keys: list[str]) -> list:
    if keys == ["year", "quarter"]:
        return [F.concat(F.col("year").cast("string"), F.lit("-"), F.col("quarter").cast("string")).alias("yq_id")]
    return []


def period_inflow(orders: DataFrame, grain: str = "year") -> DataFrame:
    """Customers, items sold, revenue, COGS, margin and AOV per period."""
    keys = grain_keys(grain)
    return _inflow(orders, grain).select(
        *_yq(keys), *keys, "unique_customers", "qty_sold",
        money("revenue").alias("revenue"), money("total_cogs").alias("total_cogs"),
        money("margin").alias("margin"), "aov",
    )


def period_refunds(refunds: DataFrame, grain: str = "year") -> DataFrame:
    """Refunded items and refund volume per period."""
    keys = grain_keys(grain)
    return _outflow(refunds, grain).select(
        *_yq(keys), *keys, "qty_refunds", money("refund_volume_usd").alias("refund_volume_usd"))


def period_financials_basic(orders: DataFrame, refunds: DataFrame, grain: str = "year") -> DataFrame:
    """Money in joined with money out per period (periods without orders drop)."""
    keys = grain_keys(grain)
    joined = _inflow(orders, grain).join(_outflow(refunds, grain), keys, "left")
    return joined.select(
        *keys, "unique_customers", "qty_sold", "qty_refunds",
        money("revenue").alias("revenue_usd"),
        money("refund_volume_usd").alias("refund_volume_usd"),
        money("total_cogs").alias("total_cogs"), money("margin").alias("margin"), "aov",
    ).orderBy(*keys)


def period_financials(orders: DataFrame, refunds: DataFrame, grain: str = "year") -> DataFrame:
    """F3d / F4c: the final financial summary per period.

    refund_rate = refunded items / items sold; total_refund_losses = refund
    volume + all COGS; margin_less_refund_losses = revenue - that. A period
    without refunds has NULL in every refund-derived column.
    """
    keys = grain_keys(grain)
    joined = _inflow(orders, grain).join(_outflow(refunds, grain), keys, "left")
    losses = F.col("refund_volume_usd") + F.col("total_cogs")
    cogs_name = "cogs_usd" if grain != "year" else "total_cogs"
    return joined.select(
        *keys, "unique_customers", "qty_sold", "qty_refunds",
        ratio("qty_refunds", "qty_sold").alias("refund_rate"),
        money("revenue").alias("revenue_usd"),
        money("refund_volume_usd").alias("refund_volume_usd"),
        money("total_cogs").alias(cogs_name),
        money(losses).alias("total_refund_losses"),
        money("margin").alias("margin"),
        money(F.col("revenue") - losses).alias("margin_less_refund_losses"),
        "aov",
    ).orderBy(*keys)
