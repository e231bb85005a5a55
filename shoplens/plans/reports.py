"""The report catalog: every registered report as a function of the shop tables.

``reports(parameters)`` builds it. The parameters that the SQL scripts paste as
literals (page lists, cutoff, renames) default to the scripts' values;
``FIXTURE`` holds those of the fixture data (FIXTURES.md §2, "Report
parameters") and ``REPORTS`` is the catalog for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.collation import collate_tables
from shoplens.operators import audits, customers, financials, prep, products, website
from shoplens.sources.tables import ShopTables

# Fixture parameters.
FIXTURE_PRODUCT_PAGES: dict[str, int | None] = {
    "/view-0": 1, "/view-1": 2, "/view-2": 3, "/view-3": 4, "/click-0": None,
}
FIXTURE_CUTOFF = "2024-01-30 12:00:00"
FIXTURE_FUNNEL: list[tuple[str, list[str]]] = [
    ("lander", ["/view-0"]),
    ("product", ["/view-1", "/view-2", "/view-3"]),
    ("cart", [f"/click-{i}" for i in range(4)]),
    ("shipping", [f"/signup-{i}" for i in range(4)]),
    ("billing", [f"/error-{i}" for i in range(4)]),
    ("thanks", [f"/purchase-{i}" for i in range(4)]),
]
FIXTURE_URL_RENAMES = dict(zip(["/view-0", "/view-1", "/view-2", "/view-3"], prep.PRODUCT_URLS.values()))

# Statements in order, each seeing what the earlier ones made.
FIXTURE_URL_UPDATES = [
    ("/view-0", "/view-1"), ("/view-1", "/view-2"), ("/click-0", "/click-1"), ("/view-2", "/start"),
    ("/click-1", "/view-0"), ("/view-3", None),
]


def mixed_spelling(t: ShopTables) -> ShopTables:
    """The tables with URLs and campaigns in three spellings, dealt by id (the fixtures have one each)."""
    def spell(column: str, key: str, letter: str, accented: str) -> Column:
        value, turn = F.col(column), F.col(key) % 3
        return F.when(turn == 1, F.upper(value)).when(turn == 2, F.replace(value, F.lit(letter), F.lit(accented))).otherwise(value)

    return t.with_tables(
        session_summary=None,
        website_pageviews=t.website_pageviews.withColumn("pageview_url", spell("pageview_url", "website_pageview_id", "e", "é")),
        website_sessions=t.website_sessions.withColumn("utm_campaign", spell("utm_campaign", "website_session_id", "a", "á")),
    )


@dataclass(frozen=True)
class Parameters:
    """What the reports take besides the tables."""

    product_pages: Mapping[str, int | None] = field(default_factory=lambda: products.PRODUCT_PAGES)
    cutoff: str = website.ACTIVE_CUTOFF
    funnel: Sequence[tuple[str, Sequence[str]]] = field(default_factory=lambda: website.FUNNEL_STAGES)
    url_renames: Mapping[str, str] = field(default_factory=lambda: prep.PRODUCT_URLS)
    web_grain: str = "year"
    visitor_grain: str = "year"

    def pages(self) -> list[str]:
        """The URLs that reports compare with."""
        return list(dict.fromkeys([url for _, urls in self.funnel for url in urls] + list(self.product_pages) + website.LANDING_PAGES))


FIXTURE = Parameters(
    FIXTURE_PRODUCT_PAGES, FIXTURE_CUTOFF, FIXTURE_FUNNEL, FIXTURE_URL_RENAMES,
    web_grain="day",       # events span one month
    visitor_grain="week",  # a session is one user-day: at day grain visitors = sessions
)

Report = Callable[[ShopTables], DataFrame]


def _both(name: str, fn: Callable[[DataFrame], DataFrame]) -> dict[str, Report]:
    """Register a customer report on the store orders and on the web orders."""
    return {name: lambda t: fn(t.orders), f"{name}_web": lambda t: fn(t.web_orders)}


def reports(p: Parameters = Parameters()) -> dict[str, Report]:
    def one_spelling(t: ShopTables) -> ShopTables:
        return collate_tables(mixed_spelling(t), pages=p.pages())

    return {
        # Section 1: financials
        "inflow_annual": lambda t: financials.period_inflow(t.orders, "year"),
        "refunds_annual": lambda t: financials.period_refunds(t.order_item_refunds, "year"),
        "financials_annual_basic": lambda t: financials.period_financials_basic(t.orders, t.order_item_refunds, "year"),
        "financials_annual": lambda t: financials.period_financials(t.orders, t.order_item_refunds, "year"),
        "inflow_quarterly": lambda t: financials.period_inflow(t.orders, "quarter"),
        "refunds_quarterly": lambda t: financials.period_refunds(t.order_item_refunds, "quarter"),
        "financials_quarterly": lambda t: financials.period_financials(t.orders, t.order_item_refunds, "quarter"),
        "audit_fanout_sums": lambda t: audits.fanout_sums(t.orders, t.order_item_refunds, "year"),
        "audit_key_duplicates": lambda t: audits.fanout_audit(
            t.orders, t.order_item_refunds, "order_id", "orders", "order_item_refunds"),
        "first_refund_per_order": lambda t: audits.first_refund_per_order(t.order_item_refunds),
        "repeat_refund_items": lambda t: audits.repeat_refund_items(t.order_item_refunds),
        "repeat_refund_orders": lambda t: audits.repeat_refund_orders(t.orders, t.order_item_refunds),
        "repeat_refund_items_by_time": lambda t: audits.repeat_refund_items_by_time(t.order_item_refunds),
        "coincident_refunds": lambda t: audits.coincident_refunds(t.order_item_refunds),
        "claimed_keys": lambda t: audits.key_audit(t),
        # Section 2: customers
        "visitor_buy_rate": lambda t: customers.visitor_buy_rate(t.website_sessions, t.web_orders, p.visitor_grain),
        "revenue_per_visitor_session": lambda t: customers.revenue_per_visitor_session(
            t.website_sessions, t.web_orders, p.visitor_grain),
        "revenue_per_visitor_session_attributed": lambda t: customers.revenue_per_visitor_session_attributed(
            t.website_sessions, t.web_orders, p.visitor_grain),
        "pageviews_per_session": lambda t: customers.pageviews_per_session(t.website_pageviews, t.session_summary),
        "session_buy_tags": lambda t: customers.session_buy_tags(
            t.website_sessions, t.web_orders, t.website_pageviews, t.session_summary),
        "avg_pageviews_by_bucket": lambda t: customers.avg_pageviews_by_bucket(
            t.website_sessions, t.web_orders, t.website_pageviews, t.session_summary),
        **_both("order_customer_totals", customers.order_customer_totals),
        **_both("orders_per_customer", customers.orders_per_customer),
        **_both("lifetime_order_histogram", customers.lifetime_order_histogram),
        **_both("order_sequence", customers.order_sequence),
        **_both("sequence_by_year", lambda o: customers.sequence_by_period(o, 3, "year")),
        **_both("aov_by_sequence", lambda o: customers.aov_by_sequence(o, 3, "year")),
        "pct_orders_refunded": lambda t: customers.pct_orders_refunded(t.orders, t.order_item_refunds),
        "refund_items_per_order": lambda t: customers.refund_items_per_order(t.order_item_refunds),
        "orders_refund_tags": lambda t: customers.orders_refund_tags(t.orders, t.order_item_refunds),
        "customers_by_refund_count": lambda t: customers.customers_by_refund_count(t.orders, t.order_item_refunds),
        "refund_rate": lambda t: customers.refund_rate(t.orders, t.order_item_refunds),
        "customers_above_avg_refund_rate": lambda t: customers.customers_above_avg_refund_rate(
            t.orders, t.order_item_refunds),
        **_both("lifetime_spend_buckets", customers.lifetime_spend_buckets),
        # Section 3: products
        "product_lifetime": lambda t: products.product_financials(t.order_items, t.order_item_refunds, t.products),
        "first_standalone_order": lambda t: products.first_standalone_order(t.orders, t.products),
        "product_annual": lambda t: products.product_financials(
            t.order_items, t.order_item_refunds, t.products, "year"),
        "refund_total": lambda t: products.refund_total(t.order_item_refunds),
        "product_refund_share": lambda t: products.product_refund_share(t.order_items, t.order_item_refunds, t.products),
        "product_quarterly": lambda t: products.product_financials(
            t.order_items, t.order_item_refunds, t.products, "quarter"),
        "product_monthly": lambda t: products.product_financials(
            t.order_items, t.order_item_refunds, t.products, "month"),
        "product_all_grains": lambda t: products.product_financials_by_grains(
            t.order_items, t.order_item_refunds, t.products),
        "primary_product_mix": lambda t: products.primary_product_mix(t.orders),
        "addon_items": lambda t: products.addon_items(t.orders, t.order_items, t.products),
        "addon_items_by_item_product": lambda t: products.addon_items_by_item_product(t.orders, t.order_items, t.products),
        "price_ranges": lambda t: products.price_ranges(t.order_items),
        "unit_margin": lambda t: products.unit_margin(t.order_items, t.products),
        "first_product_pageview": lambda t: products.first_product_pageview(t.website_pageviews, p.product_pages),
        "product_bounce_sessions": lambda t: products.product_bounce_sessions(t.website_pageviews, p.product_pages),
        "product_bounce_rate": lambda t: products.product_bounce_rate(t.website_pageviews, p.product_pages),
        "product_bounce_rate_by_day": lambda t: products.product_bounce_rate(
            t.website_pageviews, p.product_pages, p.web_grain),
        # Section 4: website
        "sessions_by_period": lambda t: website.sessions_by_period(t.website_sessions, p.web_grain),
        "page_first_view": lambda t: website.page_first_view(t.website_pageviews),
        "page_lifetime": lambda t: website.page_lifetime(t.website_pageviews),
        "entry_pages": lambda t: website.entry_pages(t.website_pageviews, t.session_summary),
        "session_landing": lambda t: website.session_landing(t.website_pageviews, t.session_summary),
        "landing_pages": lambda t: website.landing_pages(t.website_pageviews, t.session_summary),
        "session_pageview_counts": lambda t: website.session_pageview_counts(t.website_pageviews, t.session_summary),
        "landing_bounce_rate": lambda t: website.landing_bounce_rate(t.website_pageviews, t.session_summary),
        "last_order": lambda t: website.last_order(t.web_orders),
        "landing_status": lambda t: website.landing_status(t.website_pageviews, p.cutoff, None, t.session_summary),
        "landing_status_rows": lambda t: website.landing_status_rows(
            t.website_pageviews, p.cutoff, None, t.session_summary),
        "traffic_tuples": lambda t: website.traffic_tuples(t.website_sessions),
        "paid_share": lambda t: website.paid_share(t.website_sessions),
        "campaigns": lambda t: website.campaigns(t.website_sessions),
        "campaign_sessions": lambda t: website.campaign_sessions(t.website_sessions, p.web_grain),
        "campaign_revenue": lambda t: website.campaign_revenue(t.website_sessions, t.web_orders, p.web_grain),
        "paid_sources": lambda t: website.paid_sources(t.website_sessions),
        "order_rate": lambda t: website.order_rate(t.website_sessions, t.web_orders, p.web_grain),
        "distinct_urls": lambda t: website.distinct_urls(t.website_pageviews),
        "url_pageviews": lambda t: website.url_pageviews(t.website_pageviews),
        "session_pageviews": lambda t: website.session_pageviews(t.website_pageviews),
        "funnel": lambda t: website.funnel(t.website_pageviews, t.website_sessions, p.funnel, p.web_grain),
        "funnel_sessions": lambda t: website.funnel_sessions(
            t.website_pageviews, t.website_sessions, p.funnel, p.web_grain),
        # The reference's own grains (one period on the one-month fixture events).
        "visitor_buy_rate_by_year": lambda t: customers.visitor_buy_rate(t.website_sessions, t.web_orders, "year"),
        "revenue_per_visitor_session_by_year": lambda t: customers.revenue_per_visitor_session(
            t.website_sessions, t.web_orders, "year"),
        "sessions_by_year": lambda t: website.sessions_by_period(t.website_sessions, "year"),
        "campaign_sessions_by_year": lambda t: website.campaign_sessions(t.website_sessions, "year"),
        "order_rate_by_month": lambda t: website.order_rate(t.website_sessions, t.web_orders, "month"),
        "funnel_by_month": lambda t: website.funnel(t.website_pageviews, t.website_sessions, p.funnel, "month"),
        # Case- and accent-insensitive keys (the target schema's collation)
        "url_pageviews_collated": lambda t: website.url_pageviews(one_spelling(t).website_pageviews),
        "campaign_sessions_collated": lambda t: website.campaign_sessions(one_spelling(t).website_sessions, p.web_grain),
        "funnel_collated": lambda t: website.funnel(
            one_spelling(t).website_pageviews, one_spelling(t).website_sessions, p.funnel, p.web_grain),
        # Data preparation
        "recode_urls_in_order": lambda t: prep.apply_updates(
            t.website_pageviews, "pageview_url", "pageview_url", FIXTURE_URL_UPDATES),
        "published_row_counts": lambda t: prep.row_counts(t),
        "recode_product_names": lambda t: prep.recode(t.products, "product_id", "product_name", prep.PRODUCT_NAMES),
        "recode_urls": lambda t: prep.recode(t.website_pageviews, "pageview_url", "pageview_url", p.url_renames),
    }


REPORTS: dict[str, Report] = reports(FIXTURE)
