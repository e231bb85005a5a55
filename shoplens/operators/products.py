"""Product line reports.

Item-level facts are aggregated per product before the product names are
joined, so the name join sees one row per product (and period): Spark's
size check decides between broadcast and shuffle join for it. Refunds
are reduced to one row per item before meeting the items, and a refund
count weight reproduces the reference's 1:n join (SURVEY Q23) without
replicating rows; a product holding most of the items is handled by the
partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.measures import count_when, grain_keys, money, pct, with_grain

# The reference's product pages (URL -> product id; the
# cart counts as a product page without a product).
PRODUCT_PAGES: dict[str, int | None] = {
    "/high-score-hoodie": 1,
    "/power-up-pants": 2,
    "/cheat-code-cap": 3,
    "/side-quest-shirt": 4,
    "/cart": None,
}


def _names(products: DataFrame, key: str = "product_id") -> DataFrame:
    return products.select(F.col("product_id").alias(key), "product_name")


def _item_facts(items: DataFrame, refunds: DataFrame) -> DataFrame:
    per_item = refunds.groupBy("order_item_id").agg(
        F.count(F.lit(1)).alias("n_refunds"), F.sum("refund_amount_usd").alias("refund_amount"))
    w = F.coalesce(F.col("n_refunds"), F.lit(1))
    return items.join(per_item, "order_item_id", "left").select(
        "product_id", "created_at",
        (F.col("price_usd") * w).alias("price_w"), (F.col("cogs_usd") * w).alias("cogs_w"),
        "refund_amount",
    )


def product_financials(
    items: DataFrame, refunds: DataFrame, products: DataFrame, grain: str | None = None,
) -> DataFrame:
    """P1 (grain None), P3 (year), P5 (quarter): revenue, margin and refund
    volume per product and period."""
    keys = grain_keys(grain) if grain else []
    facts = _item_facts(items, refunds)
    if grain:
        facts = with_grain(facts, "created_at", grain)
    agg = facts.groupBy("product_id", *keys).agg(
        F.sum("price_w").alias("revenue"), F.sum("cogs_w").alias("cogs"),
        F.sum("refund_amount").alias("refund_volume"))
    out = agg.join(_names(products), "product_id", "left").select(
        "product_name", *keys, "product_id",
        money("revenue").alias("revenue"),
        money(F.col("revenue") - F.col("cogs")).alias("margin"),
        money("refund_volume").alias("refund_volume"),
    )
    if grain == "year":
        return out.orderBy("product_id", "product_name", "year")
    if grain:
        return out.orderBy("product_id", *keys)
    return out


# Period columns of each grain.
GRAIN_SETS: dict[str, list[str]] = {
    "lifetime": [], "year": ["year"], "quarter": ["year", "quarter"], "month": ["year", "month"],
}


def product_financials_by_grains(
    items: DataFrame, refunds: DataFrame, products: DataFrame, grains: Sequence[str] = tuple(GRAIN_SETS),
) -> DataFrame:
    """P1, P3 and P5 in one report: a ``grain`` column and a row per product and period of each.

    The items meet their refunds once and are summed to product and shortest period, within
    each task first; those sums go to their product's task and meet its name there. Windows
    of that task add them up to the longer periods, so rows are multiplied by the number of
    grains after the last shuffle, and one sort serves the windows and the join. Period
    columns a grain does not have are NULL; undated items have a NULL period in every grain.
    """
    unknown = set(grains) - set(GRAIN_SETS)
    if unknown or not grains:
        raise ValueError(f"grains must be some of {list(GRAIN_SETS)}, got {list(grains)}")
    grains = list(dict.fromkeys(grains))
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month}
    periods = [c for c in parts if any(c in GRAIN_SETS[g] for g in grains)]
    sums = ["price_w", "cogs_w", "refund_amount"]
    # The first day of the shortest period: one date is dealt out instead of a column a period.
    facts = _item_facts(items, refunds).withColumns({"year_month": F.trunc(F.to_date("created_at"), c) for c in periods[-1:]})
    found = facts.groupBy("product_id", *["year_month" for _ in periods[-1:]]).agg(*[F.sum(c).alias(c) for c in sums])
    found = found.repartition("product_id").select(
        "product_id", *[parts[c]("year_month").alias(c) for c in periods], *sums).sortWithinPartitions("product_id", *periods)

    def rolled(grain: str):
        """The period's sums on the first of its rows, NULL on the others."""
        # A month lies in one quarter, so the sort by quarter in between holds for months too.
        keys = [c for c in periods if c in GRAIN_SETS[grain] or (c == "quarter" and grain == "month")]
        rest = [c for c in periods if c not in keys]
        within = Window.partitionBy("product_id", *keys).orderBy(*rest)
        whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        price, cogs, refund = [F.sum(c).over(whole) if rest else F.col(c) for c in sums]
        row = F.struct(
            *[(F.col(c) if c in GRAIN_SETS[grain] else F.lit(None).cast("int")).alias(c) for c in parts],
            money(price).alias("revenue"), money(price - cogs).alias("margin"), money(refund).alias("refund_volume"))
        return (F.when(F.row_number().over(within) == 1, row) if rest else row).alias(grain)

    named = found.select("product_id", *[rolled(g) for g in grains]).join(_names(products), "product_id", "left")
    return named.unpivot(["product_id", "product_name"], grains, "grain", "sums").where("sums IS NOT NULL").select(
        "grain", "product_name", "product_id", "sums.*")


def first_standalone_order(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Launch date, first single-item order date and the days between."""
    solo = orders.where(F.col("items_purchased") == 1).groupBy(
        F.col("primary_product_id").alias("product_id")
    ).agg(F.min("created_at").alias("first_standalone_order_date"))
    launches = products.select("product_id", "product_name", F.col("created_at").alias("launch_date"))
    j = solo.join(launches, "product_id", "left")
    return j.select(
        "product_name", "product_id", "launch_date", "first_standalone_order_date",
        F.datediff(F.to_date("first_standalone_order_date"), F.to_date("launch_date"))
        .alias("days_until_standalone_order"),
    )


def refund_total(refunds: DataFrame) -> DataFrame:
    """Total refund volume."""
    return refunds.agg(money(F.sum("refund_amount_usd")).alias("total_refund_volume"))


def product_refund_share(items: DataFrame, refunds: DataFrame, products: DataFrame) -> DataFrame:
    """Each product's share (%) of the total refund volume. The total
    is a scalar subquery over the refunds table (one value), not a pasted
    literal and not a window over all products."""
    total = refunds.agg(F.sum("refund_amount_usd")).scalar()
    agg = _item_facts(items, refunds).groupBy("product_id").agg(
        F.sum("refund_amount").alias("refund_volume"))
    return agg.join(_names(products), "product_id", "left").select(
        "product_id", "product_name", pct("refund_volume", total).alias("pct_refund_volume"),
    ).orderBy("product_id", "product_name")


def primary_product_mix(orders: DataFrame) -> DataFrame:
    """Orders per primary product."""
    return orders.groupBy("primary_product_id").agg(F.count("order_id").alias("order_count"))


def addon_items(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Add-on (non-primary) items of multi-item orders, by the order's
    primary product; primary products without add-ons show 0 (Q14)."""
    per_order = items.where(F.col("is_primary_item") != 1).groupBy("order_id").agg(
        F.count("order_item_id").alias("n_addons"))
    j = orders.where(F.col("items_purchased") > 1).select("order_id", "primary_product_id").join(
        per_order, "order_id", "left")
    agg = j.groupBy("primary_product_id").agg(
        F.coalesce(F.sum("n_addons"), F.lit(0)).alias("added_on_to_orders"))
    return agg.join(_names(products, "primary_product_id"), "primary_product_id", "left").select(
        "primary_product_id", "product_name", "added_on_to_orders")


def addon_items_by_item_product(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """P7 companion (Q13): the same add-on items grouped by their own product.

    Add-ons are first counted per (order, product), a partial aggregation
    that shrinks an order with a huge number of items to one row per
    product before the semi join with the multi-item orders.
    """
    per_order_product = items.where(F.col("is_primary_item") != 1).groupBy("order_id", "product_id").agg(
        F.count("order_item_id").alias("n"))
    multi = orders.where(F.col("items_purchased") > 1).select("order_id")
    agg = per_order_product.join(multi, "order_id", "left_semi").groupBy("product_id").agg(
        F.sum("n").alias("added_on_to_orders"))
    return agg.join(_names(products), "product_id", "left").select(
        "product_id", "product_name", "added_on_to_orders")


def price_ranges(items: DataFrame) -> DataFrame:
    """Lowest and highest price and cost per product."""
    return items.groupBy("product_id").agg(
        money(F.min("price_usd")).alias("lowest_price"), money(F.max("price_usd")).alias("highest_price"),
        money(F.min("cogs_usd")).alias("lowest_cogs"), money(F.max("cogs_usd")).alias("highest_cogs"),
    )


def unit_margin(items: DataFrame, products: DataFrame) -> DataFrame:
    """Lifetime margin per product and distinct unit margin."""
    unit = (F.col("price_usd") - F.col("cogs_usd")).alias("unit")
    agg = items.groupBy("product_id", unit).agg(
        F.sum("price_usd").alias("p"), F.sum("cogs_usd").alias("c"))
    return agg.join(_names(products), "product_id", "left").select(
        "product_id", "product_name",
        money(F.col("p") - F.col("c")).alias("total_lifetime_margin"),
        money("unit").alias("per_item_margin"),
    )


# --- P10: product page bounce ---------------------------------------------

def _product_sessions(pageviews: DataFrame, pages: Mapping[str, int | None]) -> DataFrame:
    """Per session, over its pageviews of the listed pages: first pageview id,
    its URL and time, and the number of such pageviews (one aggregation).

    The page list is a parameter, so the URL travels through the aggregation
    as its position in that list (an INT): the first-page pick is then a
    hash aggregate, and the URL is looked up again afterwards.
    """
    urls = F.array(*[F.lit(u) for u in pages])
    code = F.array_position(urls, F.col("pageview_url")).cast("int")
    agg = pageviews.where(F.col("pageview_url").isin(list(pages))).groupBy("website_session_id").agg(
        F.min("website_pageview_id").alias("first_product_pageview_id"),
        F.min_by(code, "website_pageview_id").alias("page_code"),
        F.min_by("created_at", "website_pageview_id").alias("first_seen"),
        F.count("website_pageview_id").alias("pageviews"),
    )
    return agg.select(
        "website_session_id", "first_product_pageview_id",
        F.element_at(urls, F.col("page_code")).alias("pageview_url"), "first_seen", "pageviews")


def _page_product(pages: Mapping[str, int | None]):
    ids = {u: p for u, p in pages.items() if p is not None}
    if not ids:
        return F.lit(None).cast("bigint")
    lookup = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.try_element_at(lookup, F.col("pageview_url")).cast("bigint")


def first_product_pageview(pageviews: DataFrame, pages: Mapping[str, int | None] = PRODUCT_PAGES) -> DataFrame:
    """Each session's first pageview among the product pages."""
    return _product_sessions(pageviews, pages).select(
        "website_session_id", "first_product_pageview_id", "pageview_url")


def _bounced():
    """One product pageview; pageviews without a session are no session's bounce."""
    return (F.col("pageviews") == 1) & F.col("website_session_id").isNotNull()


def product_bounce_sessions(pageviews: DataFrame, pages: Mapping[str, int | None] = PRODUCT_PAGES) -> DataFrame:
    """Sessions with exactly one pageview among the product pages."""
    return _product_sessions(pageviews, pages).where(_bounced()).select(
        "website_session_id", "pageview_url", "pageviews")


def product_bounce_rate(
    pageviews: DataFrame, pages: Mapping[str, int | None] = PRODUCT_PAGES, grain: str | None = None,
) -> DataFrame:
    """P10c (grain None) / P10d: bounce rate (%) per first product page,
    optionally per period of that first product pageview."""
    s = _product_sessions(pageviews, pages)
    keys = grain_keys(grain) if grain else []
    if grain:
        s = with_grain(s, "first_seen", grain)
    agg = s.groupBy(*keys, "pageview_url").agg(
        pct(count_when(_bounced()), F.count("website_session_id")).alias("bounce_rate"))
    out = agg.select(
        *keys, _page_product(pages).alias("product_id"),
        F.col("pageview_url").alias("product_page"), "bounce_rate")
    return out.orderBy(*keys, "product_id")
