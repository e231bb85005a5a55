"""Build small shop tables from hand-written rows (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shoplens.sources.tables import ShopTables

DDL = {
    "orders": "order_id bigint, created_at timestamp_ntz, website_session_id bigint, user_id bigint, "
              "primary_product_id bigint, items_purchased int, price_usd decimal(12,2), cogs_usd decimal(18,4)",
    "order_items": "order_item_id bigint, created_at timestamp_ntz, order_id bigint, product_id bigint, "
                   "is_primary_item int, price_usd decimal(12,2), cogs_usd decimal(18,4)",
    "order_item_refunds": "order_item_refund_id bigint, created_at timestamp_ntz, order_item_id bigint, "
                          "order_id bigint, refund_amount_usd decimal(18,4)",
    "products": "product_id bigint, created_at timestamp_ntz, product_name string",
    "website_sessions": "website_session_id bigint, created_at timestamp_ntz, user_id bigint, utm_source string, "
                        "utm_campaign string, utm_content string, device_type string",
    "website_pageviews": "website_pageview_id bigint, created_at timestamp_ntz, website_session_id bigint, "
                         "pageview_url string",
}
DDL["web_orders"] = DDL["orders"]


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(x) -> Decimal:
    return Decimal(str(x))


def table(spark, name: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema=DDL[name])


def tables(spark, **rows) -> ShopTables:
    """ShopTables with the given rows per table (others empty)."""
    return ShopTables(**{name: table(spark, name, rows.get(name, [])) for name in DDL})


def order(oid, when, user, price, items=1, cogs=0, session=None, product=1):
    return (oid, ts(when), session, user, product, items, d(price), d(cogs))


def item(iid, when, oid, product, price, cogs=0, primary=1):
    return (iid, ts(when), oid, product, primary, d(price), d(cogs))


def refund(rid, when, iid, oid, amount):
    return (rid, ts(when), iid, oid, d(amount))


def session(sid, when, user, source=None, campaign=None, content=None, device="desktop"):
    return (sid, ts(when), user, source, campaign, content, device)


def pageview(pid, when, sid, url):
    return (pid, ts(when), sid, url)
