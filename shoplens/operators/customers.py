"""Customer base reports.

Scale notes:

* Sessions joined to orders on ``user_id`` is many-to-many (SURVEY Q1).
  The literal numbers are reproduced without materialising the pairs:
  sessions are reduced to (period, user, n_sessions), orders to
  (user, revenue, n_orders), and the two join one row to one row.
* Repeat-order sequencing needs only each customer's first ``depth``
  orders: ``row_number() <= depth`` lets Spark run a partial per-user
  top-k before the shuffle (WindowGroupLimit), so a customer with a huge
  order count ships at most ``depth`` rows per map task.
* Lifetime buckets need only count and spend per customer: plain partial
  aggregations, no window at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.measures import count_when, grain_keys, mean, money, ratio, with_grain

ORDINALS = {1: "first", 2: "second", 3: "third"}


def _ordinal(k: int) -> str:
    return ORDINALS.get(k, f"{k}th")


# --- C1, C2: visitors and their revenue -----------------------------------

def _visits(sessions: DataFrame, grain: str) -> DataFrame:
    keys = grain_keys(grain)
    return with_grain(sessions, "created_at", grain).groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("n_sessions"))


def _visitor_value(sessions: DataFrame, orders: DataFrame, grain: str) -> DataFrame:
    keys = grain_keys(grain)
    buyers = orders.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.sum("price_usd").alias("user_revenue"), F.count(F.lit(1)).alias("n_orders"))
    j = _visits(sessions, grain).join(buyers, "user_id", "left")
    return j.groupBy(*keys).agg(
        F.count("user_id").alias("visitors"),
        count_when(F.col("n_orders").isNotNull()).alias("buyers"),
        F.sum("n_sessions").alias("sessions"),
        F.sum(F.col("user_revenue") * F.col("n_sessions")).alias("revenue"),
    )


def visitor_buy_rate(sessions: DataFrame, orders: DataFrame, grain: str = "year") -> DataFrame:
    """Share of a period's visitors that bought (at any time; the join is on user)."""
    keys = grain_keys(grain)
    v = _visitor_value(sessions, orders, grain)
    return v.select(*keys, ratio("buyers", "visitors").alias("pct_of_visitors_bought"))


def revenue_per_visitor_session(sessions: DataFrame, orders: DataFrame, grain: str = "year") -> DataFrame:
    """C2, literal: revenue of visiting users' orders (every order counted once per
    session of its user in the period) per visitor and per session."""
    keys = grain_keys(grain)
    v = _visitor_value(sessions, orders, grain)
    return v.select(
        *keys,
        ratio("revenue", "visitors").alias("revenue_per_visitor"),
        ratio("revenue", "sessions").alias("revenue_per_session"),
    )


def revenue_per_visitor_session_attributed(
    sessions: DataFrame, orders: DataFrame, grain: str = "year",
) -> DataFrame:
    """C2 companion (Q1): revenue of orders placed in the period's sessions."""
    keys = grain_keys(grain)
    per_session = orders.groupBy("website_session_id").agg(F.sum("price_usd").alias("session_revenue"))
    j = with_grain(sessions, "created_at", grain).join(per_session, "website_session_id", "left")
    v = j.groupBy(*keys).agg(
        F.countDistinct("user_id").alias("visitors"),
        F.count("website_session_id").alias("sessions"),
        F.sum("session_revenue").alias("revenue"),
    )
    return v.select(
        *keys,
        ratio("revenue", "visitors").alias("revenue_per_visitor"),
        ratio("revenue", "sessions").alias("revenue_per_session"),
    )


# --- C3: pageviews of buying vs non-buying sessions -----------------------

def pageviews_per_session(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Pageviews per session (read from the session summary when given)."""
    if summary is not None:
        return summary.select("website_session_id", F.col("session_pageviews").alias("pvs_by_session"))
    return pageviews.groupBy("website_session_id").agg(
        F.count("website_pageview_id").alias("pvs_by_session"))


def session_buy_tags(
    sessions: DataFrame, orders: DataFrame, pageviews: DataFrame, summary: DataFrame | None = None,
) -> DataFrame:
    """Each session with its pageview count and a buy tag (1 or NULL).
    A session with k orders appears k times, as in the reference."""
    s = sessions.select("website_session_id").join(
        pageviews_per_session(pageviews, summary), "website_session_id", "left")
    # One row per order meets its session's single row, so the copies of a
    # session stay spread over the tasks that hold its orders (the join's
    # order side splits); sessions without orders follow once.
    placed = orders.where(F.col("website_session_id").isNotNull()).select("website_session_id")
    bought = placed.join(s, "website_session_id").select(
        "website_session_id", "pvs_by_session", F.lit(1).alias("buy_session_tag"))
    idle = s.join(placed.distinct(), "website_session_id", "left_anti").select(
        "website_session_id", "pvs_by_session", F.lit(None).cast("int").alias("buy_session_tag"))
    return bought.union(idle)


def _orders_per_session(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("website_session_id").isNotNull()).groupBy(
        "website_session_id").agg(F.count(F.lit(1)).alias("n_orders"))


def avg_pageviews_by_bucket(
    sessions: DataFrame, orders: DataFrame, pageviews: DataFrame, summary: DataFrame | None = None,
) -> DataFrame:
    """Average pageviews per session for buying ('customer') and other
    ('visitor') sessions. A session with k orders weighs k, as in the
    reference's joined rows; the weight replaces the replication."""
    j = (
        sessions.select("website_session_id")
        .join(_orders_per_session(orders), "website_session_id", "left")
        .join(pageviews_per_session(pageviews, summary), "website_session_id", "left")
    )
    w = F.coalesce(F.col("n_orders"), F.lit(1))
    bucket = F.when(F.col("n_orders").isNotNull(), "customer").otherwise("visitor")
    return j.groupBy(bucket.alias("bucket")).agg(
        ratio(F.sum(F.col("pvs_by_session") * w),
              F.sum(F.when(F.col("pvs_by_session").isNotNull(), w))).alias("avg_pageviews_per_session"))


# --- C4: lifetime orders --------------------------------------------------

def order_customer_totals(orders: DataFrame) -> DataFrame:
    """Number of orders and of distinct customers."""
    return orders.agg(
        F.count("order_id").alias("order_qty"),
        F.countDistinct("user_id").alias("unique_customer_count"),
    )


def orders_per_customer(orders: DataFrame) -> DataFrame:
    """Lifetime orders per customer (order_id is the key: COUNT = COUNT DISTINCT)."""
    return orders.groupBy(F.col("user_id").alias("customer_id")).agg(
        F.count("order_id").alias("order_count"))


def lifetime_order_histogram(orders: DataFrame, depth: int = 3) -> DataFrame:
    """Customers per lifetime order count, with their share of all
    customers for counts 1..depth (NULL beyond, as in the reference).

    The share's denominator is a scalar subquery over the histogram, which
    has one row per distinct order count.
    """
    hist = orders_per_customer(orders).groupBy(
        F.col("order_count").alias("qty_lifetime_orders")
    ).agg(F.count("customer_id").alias("users_per_bucket"))
    total = hist.agg(F.sum("users_per_bucket")).scalar()
    share = F.when(F.col("qty_lifetime_orders").between(1, depth), ratio("users_per_bucket", total))
    return hist.select("qty_lifetime_orders", "users_per_bucket", share.alias("pct_of_customers"))


# --- C5, C6: repeat-order sequence ----------------------------------------

def _first_orders(orders: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` orders (by order id) of every customer, numbered."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("order_id"))
    return (
        orders.select("order_id", "user_id", "created_at", "price_usd", rn.alias("order_sequence_id"))
        .where(F.col("order_sequence_id") <= depth)
    )


def order_sequence(orders: DataFrame, depth: int = 3) -> DataFrame:
    """C5a-g: every order with its position 1..depth in its customer's
    history by order id; NULL for later orders."""
    firsts = _first_orders(orders, depth).select("order_id", "order_sequence_id")
    return orders.join(firsts, "order_id", "left").select(
        "order_id", F.col("user_id").alias("customer_id"), "created_at", "order_sequence_id")


def _per_period(orders: DataFrame, firsts_agg: DataFrame, grain: str) -> DataFrame:
    """Attach per-period results of the first orders to every period that has
    orders, the NULL period (orders without a time) included."""
    keys = grain_keys(grain)
    periods = with_grain(orders, "created_at", grain).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys])
    rest = [c for c in firsts_agg.columns if c not in keys]
    return periods.join(firsts_agg, same, "left").select(*[F.col(f"_{k}").alias(k) for k in keys], *rest)


def sequence_by_period(orders: DataFrame, depth: int = 3, grain: str = "year") -> DataFrame:
    """C5h: first, second, third ... orders placed per period."""
    keys = grain_keys(grain)
    seq = F.col("order_sequence_id")
    agg = with_grain(_first_orders(orders, depth), "created_at", grain).groupBy(*keys).agg(
        *[count_when(seq == k).alias(f"{_ordinal(k)}_orders") for k in range(1, depth + 1)])
    names = [f"{_ordinal(k)}_orders" for k in range(1, depth + 1)]
    return _per_period(orders, agg, grain).select(
        *keys, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def aov_by_sequence(orders: DataFrame, depth: int = 3, grain: str = "year") -> DataFrame:
    """Average order value of first, second, third ... orders per period."""
    keys = grain_keys(grain)
    seq = F.col("order_sequence_id")
    names = [f"{_ordinal(k)}_order_aov" for k in range(1, depth + 1)]
    agg = with_grain(_first_orders(orders, depth), "created_at", grain).groupBy(*keys).agg(
        *[mean(F.when(seq == k, F.col("price_usd"))).alias(n) for k, n in enumerate(names, 1)])
    return _per_period(orders, agg, grain).select(*keys, *names)


def lifetime_spend_buckets(orders: DataFrame, depth: int = 3) -> DataFrame:
    """Customers and average lifetime spend by number of orders, capped
    at ``depth`` (a customer with more orders falls in the last bucket and
    brings all their spend, as in the reference)."""
    per_customer = orders.groupBy("user_id").agg(
        F.count("order_id").alias("n_orders"), F.sum("price_usd").alias("lifetime_spend"))
    total = F.least(F.col("n_orders"), F.lit(depth))
    bucket = None
    for k in range(1, depth + 1):
        label = f"{k} order" + ("s" if k > 1 else "")
        bucket = F.when(total == k, label) if bucket is None else bucket.when(total == k, label)
    return per_customer.groupBy(bucket.alias("bucket")).agg(
        F.count("user_id").alias("customers"),
        mean("lifetime_spend").alias("avg_lifetime_spend"),
    )


# --- C7-C9: refunds per order and customer ---------------------------------

def _refunds_per_order(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy("order_id").agg(F.count("order_item_refund_id").alias("qty_items_refunded"))


def pct_orders_refunded(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Share of orders with at least one refunded item."""
    j = orders.select("order_id").join(_refunds_per_order(refunds), "order_id", "left")
    return j.agg(ratio(F.count("qty_items_refunded"), F.count("order_id")).alias("pct_orders_refunded"))


def refund_items_per_order(refunds: DataFrame) -> DataFrame:
    """Refunded items per order."""
    return _refunds_per_order(refunds).select(
        F.col("order_id").alias("refund_order_id"), "qty_items_refunded")


def orders_refund_tags(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Every order with its customer, refunded item count and refund tag."""
    j = orders.select("order_id", "user_id").join(_refunds_per_order(refunds), "order_id", "left")
    return j.select(
        "order_id", "user_id", "qty_items_refunded",
        F.when(F.col("qty_items_refunded").isNotNull(), F.lit(1)).alias("refund_tag"))


def customers_by_refund_count(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Customers by number of their orders that had a refund (0 included)."""
    per_user = orders_refund_tags(orders, refunds).groupBy("user_id").agg(
        F.count("refund_tag").alias("refund_count"))
    return per_user.groupBy("refund_count").agg(F.count("user_id").alias("customers"))


def refund_rate(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Refunded items per order (items over orders, as the reference computes)."""
    j = orders.select("order_id").join(_refunds_per_order(refunds), "order_id", "left")
    refunded = F.coalesce(F.sum("qty_items_refunded"), F.lit(0))
    return j.agg(ratio(refunded, F.count("order_id")).alias("refund_rate"))


def customers_above_avg_refund_rate(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """C9 companion (Q17): the item-basis refund rate of the business (all
    refunded items / all items sold) and how many customers exceed it with
    their own refunded items / items bought.

    The two totals are scalar subqueries over the base tables (a scan and
    a partial aggregate each, no row shuffle); the per-customer comparison
    is exact integer arithmetic, not a float test.
    """
    ti = orders.agg(F.sum("items_purchased").cast("decimal(38,0)")).scalar()
    tr = refunds.agg(F.count(F.lit(1)).cast("decimal(38,0)")).scalar()
    j = orders.where(F.col("user_id").isNotNull()).select(
        "order_id", "user_id", "items_purchased"
    ).join(_refunds_per_order(refunds), "order_id", "left")
    cust = j.groupBy("user_id").agg(
        F.sum("items_purchased").cast("decimal(38,0)").alias("items"),
        F.coalesce(F.sum("qty_items_refunded"), F.lit(0)).cast("decimal(38,0)").alias("refunded"),
    )
    above = (F.col("items") > 0) & (F.col("refunded") * ti > tr * F.col("items"))
    return cust.agg(
        F.count(F.lit(1)).alias("customers"), count_when(above).alias("customers_above_avg"),
    ).select("customers", ratio(tr, ti).alias("avg_refund_rate"), "customers_above_avg")
