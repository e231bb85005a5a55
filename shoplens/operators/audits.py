"""Join fan-out audits (F5): checks a user runs before trusting a join.

The reference demonstrates that LEFT JOIN orders -> refunds inflates the
order sums. These operators report the same numbers as that literal join
without materialising it: both sides are first reduced to one row per key
(partial aggregation, safe under key skew), and the fan-out is applied
as a multiplicity weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.measures import count_when, grain_keys, money, with_grain
from shoplens.sources.tables import CLAIMED_KEYS, ShopTables


def fanout_audit(
    left: DataFrame, right: DataFrame, key: str,
    left_name: str = "left", right_name: str = "right",
) -> DataFrame:
    """Row, distinct-key and duplicate counts of ``key`` on both sides of
    ``left LEFT JOIN right USING (key)`` (one row, six columns)."""
    lk = left.groupBy(key).agg(F.count(F.lit(1)).alias("nl"))
    rk = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("nr"))
    j = lk.join(rk, key, "left")
    left_rows = F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("nl") * F.coalesce("nr", F.lit(1)))), F.lit(0))
    right_rows = F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0))
    agg = j.agg(
        left_rows.cast("bigint").alias("lr"), F.count(key).alias("lk"),
        right_rows.cast("bigint").alias("rr"), F.count("nr").alias("rk"),
    )
    return agg.select(
        F.col("lr").alias(f"{left_name}_rows"),
        F.col("lk").alias(f"{left_name}_keys"),
        (F.col("lr") - F.col("lk")).alias(f"dupes_in_{left_name}"),
        F.col("rr").alias(f"{right_name}_rows"),
        F.col("rk").alias(f"{right_name}_keys"),
        (F.col("rr") - F.col("rk")).alias(f"dupes_in_{right_name}"),
    )


def fanout_sums(orders: DataFrame, refunds: DataFrame, grain: str = "year") -> DataFrame:
    """The order sums as the literal orders LEFT JOIN refunds computes them
    (each order counted once per matching refund row)."""
    keys = grain_keys(grain)
    per_order = refunds.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_refunds"))
    w = F.coalesce(F.col("n_refunds"), F.lit(1))
    j = with_grain(orders, "created_at", grain).join(per_order, "order_id", "left")
    return j.groupBy(*keys).agg(
        F.sum(F.col("items_purchased") * w).cast("bigint").alias("qty_sold"),
        money(F.sum(F.col("price_usd") * w)).alias("revenue"),
        money(F.sum(F.col("cogs_usd") * w)).alias("total_cogs"),
        money(F.sum((F.col("price_usd") - F.col("cogs_usd")) * w)).alias("margin"),
    )


def first_refund_per_order(refunds: DataFrame) -> DataFrame:
    """Time of the first refunded item of each order."""
    return refunds.groupBy("order_id").agg(F.min("created_at").alias("first_item_returned_at"))


def _repeat_refunds(refunds: DataFrame) -> DataFrame:
    place = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "order_item_refund_id")
    first = refunds.groupBy("order_id").agg(F.min(place).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("order_id").alias("_order"), F.col("m.order_item_refund_id").alias("_first"))
    return refunds.join(first, F.col("order_id").eqNullSafe(F.col("_order"))).where(
        F.col("order_item_refund_id") != F.col("_first")).drop("_order", "_first")


def repeat_refund_items(refunds: DataFrame) -> DataFrame:
    """F5d, keyed form: refund rows that are not their order's first refund,
    newest first. "First" is the smallest (created_at, refund id) in the
    order, so a coincident time in another order hides nothing (SURVEY Q3).

    Undated refunds come last. The first refund per order is a partial min
    aggregate (safe when one order holds most refunds); only orders with more
    than one refund meet the refunds again, one row per order.
    """
    return _repeat_refunds(refunds).select(
        "order_item_refund_id", "created_at", "order_item_id", "order_id",
        money("refund_amount_usd").alias("refund_amount_usd"),
    ).orderBy(F.col("created_at").desc(), F.col("order_item_refund_id").desc())


def _first_refund_times(refunds: DataFrame) -> DataFrame:
    """Each time at which an order's first dated refund happened, and how many orders had it then (one row a time)."""
    per_order = first_refund_per_order(refunds).where(F.col("first_item_returned_at").isNotNull())
    return per_order.groupBy(F.col("first_item_returned_at").alias("_time")).agg(F.count(F.lit(1)).alias("orders_first_refunded_then"))


def repeat_refund_items_by_time(refunds: DataFrame) -> DataFrame:
    """F5d as the script has it, matched on time alone: the refunds at whose time no order was
    first refunded (undated refunds match nothing and stay), newest first.

    The times are one row each whatever they are shared by; of the refunds, those at a
    very frequent time are split over tasks by AQE's skew join.
    """
    times = _first_refund_times(refunds).select("_time")
    return refunds.join(times, F.col("created_at") == F.col("_time"), "left_anti").select(
        "order_item_refund_id", "created_at", "order_item_id", "order_id",
        money("refund_amount_usd").alias("refund_amount_usd"),
    ).orderBy(F.col("created_at").desc(), F.col("order_item_refund_id").desc())


def coincident_refunds(refunds: DataFrame) -> DataFrame:
    """The refunds on which F5d by time and F5d by key disagree.

    ``hidden``: a repeat refund that the form by time drops, because some order (``orders_first_refunded_then`` of
    them) was first refunded at that very time. ``undated``: the first
    refund of an order without any dated one, which the form by time keeps. Only
    repeat refunds meet the times.
    """
    place = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "order_item_refund_id")
    undated = refunds.groupBy("order_id").agg(F.min(place).alias("m")).where("m.undated").select(
        F.col("m.order_item_refund_id").alias("order_item_refund_id"), F.col("m.created_at").alias("created_at"), "order_id",
        F.lit(0).cast("bigint").alias("orders_first_refunded_then"), F.lit("undated").alias("difference"))
    hidden = _repeat_refunds(refunds).where(F.col("created_at").isNotNull()).join(
        _first_refund_times(refunds), F.col("created_at") == F.col("_time")).select(
        "order_item_refund_id", "created_at", "order_id", "orders_first_refunded_then", F.lit("hidden").alias("difference"))
    return hidden.unionByName(undated)


def key_audit(tables: ShopTables) -> DataFrame:
    """One row per table: rows, rows without a key, distinct keys and keys that stand on several rows.

    Reports that count rows where the scripts count distinct ids rely on these keys.
    Each table is reduced to a row per key by partial aggregates, reading the key column only.
    """
    def measured(name: str, key: str) -> DataFrame:
        n = tables.key_column(name, key).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(
            F.lit(name).alias("table_name"), F.lit(key).alias("key_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
            F.count("k").alias("distinct_keys"),
            count_when(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
        )

    return reduce(DataFrame.union, [measured(name, key) for name, key in CLAIMED_KEYS.items()])


def repeat_refund_orders(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """F5e: the orders that had more than one item refunded (semi join)."""
    ids = _repeat_refunds(refunds).select("order_id").distinct()
    return orders.join(ids, "order_id", "left_semi").select(
        "order_id", "created_at", "website_session_id", "user_id", "primary_product_id",
        "items_purchased", money("price_usd").alias("price_usd"), money("cogs_usd").alias("cogs_usd"),
    )
