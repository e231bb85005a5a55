"""The shop data model: six tables plus the web orders.

Every report in :mod:`shoplens.operators` takes these DataFrames, never
paths, so a deployment can hand in catalog tables, a published Parquet
copy (:func:`read_published`) or the fixture mapping
(:mod:`shoplens.sources.fixture`).
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from shoplens.sources import versions

log = logging.getLogger(__name__)

# Column lists of the data model, in the order the tables are published.
SCHEMAS: dict[str, list[str]] = {
    "orders": [
        "order_id", "created_at", "website_session_id", "user_id",
        "primary_product_id", "items_purchased", "price_usd", "cogs_usd",
    ],
    "order_items": [
        "order_item_id", "created_at", "order_id", "product_id",
        "is_primary_item", "price_usd", "cogs_usd",
    ],
    "order_item_refunds": [
        "order_item_refund_id", "created_at", "order_item_id", "order_id",
        "refund_amount_usd",
    ],
    "products": ["product_id", "created_at", "product_name"],
    "website_sessions": [
        "website_session_id", "created_at", "user_id", "utm_source",
        "utm_campaign", "utm_content", "device_type",
    ],
    "website_pageviews": [
        "website_pageview_id", "created_at", "website_session_id", "pageview_url",
    ],
    # Orders placed through a website session (same columns as ``orders``).
    "web_orders": [
        "order_id", "created_at", "website_session_id", "user_id",
        "primary_product_id", "items_purchased", "price_usd", "cogs_usd",
    ],
}

# Key each table is bucketed on when published to a catalog: items and refunds
# meet on the item key; orders on the order key; sessions and the session
# summary on the session key. Pageviews and web orders stay unbucketed: a hot
# session (or the rows without one) would fill one bucket, one file and one
# task; their reports reduce them to a row per session and task first.
BUCKET_KEYS: dict[str, str] = {
    "orders": "order_id",
    "order_items": "order_item_id",
    "order_item_refunds": "order_item_id",
    "website_sessions": "website_session_id",
    "session_summary": "website_session_id",
}

# Derived table published next to the base tables: one row per session with
# its first pageview, landing URL, first time and pageview count.
SESSION_SUMMARY = [
    "website_session_id", "first_pageview_id", "landing_url", "first_pageview_visited", "session_pageviews",
]

# Columns that the reports take as keys: they count rows where the scripts count distinct values.
# ``audits.key_audit`` measures the claim, ``prep.require_keys`` refuses tables that break it.
CLAIMED_KEYS: dict[str, str] = {
    "orders": "order_id", "order_items": "order_item_id", "order_item_refunds": "order_item_refund_id",
    "products": "product_id", "website_sessions": "website_session_id",
    "website_pageviews": "website_pageview_id", "web_orders": "order_id",
}

# Table property of a catalog's session summary: the version of the pageviews it was made from.
SUMMARY_OF = "shoplens.summary_of"


@dataclass(frozen=True)
class ShopTables:
    orders: DataFrame
    order_items: DataFrame
    order_item_refunds: DataFrame
    products: DataFrame
    website_sessions: DataFrame
    website_pageviews: DataFrame
    web_orders: DataFrame
    # Optional derived table (see SESSION_SUMMARY); computed when absent.
    session_summary: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        """The base tables (not the derived summary), in model order."""
        return [(name, getattr(self, name)) for name in SCHEMAS]

    def summary(self) -> DataFrame:
        """Per-session summary: the published one, else computed from pageviews."""
        if self.session_summary is not None:
            return self.session_summary
        from shoplens.operators.website import session_summary

        return session_summary(self.website_pageviews)

    def key_column(self, name: str, key: str) -> DataFrame:
        """The key column of a table."""
        return getattr(self, name).select(key)

    def with_tables(self, **changes: DataFrame | None) -> "ShopTables":
        return replace(self, **changes)

    def with_summary(self, df: DataFrame) -> "ShopTables":
        return self.with_tables(session_summary=df)


class TablesOnDemand:
    """Shop tables of which each is made at its first use.

    ``make(name)`` is asked once for each table that a report reads (names of
    ``SCHEMAS``, and ``session_summary``); the rest are never made. Attributes and methods are
    those of :class:`ShopTables`. ``make_key(name, key)`` makes a key column alone, where that takes less than its table.
    """

    def __init__(self, make: Callable[[str], DataFrame | None], make_key: Callable[[str, str], DataFrame] | None = None):
        self._make, self._make_key, self._made, self._lock = make, make_key, {}, threading.RLock()

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in SCHEMAS and name != "session_summary":
            raise AttributeError(name)
        with self._lock:
            if name not in self._made:
                self._made[name] = self._make(name)
            return self._made[name]

    items = ShopTables.items
    summary = ShopTables.summary
    with_summary = ShopTables.with_summary

    def key_column(self, name: str, key: str) -> DataFrame:
        if self._make_key is None or name in self._made:
            return getattr(self, name).select(key)
        return self._make_key(name, key)

    def with_tables(self, **changes: DataFrame | None) -> "TablesOnDemand":
        return TablesOnDemand(
            lambda name: changes[name] if name in changes else getattr(self, name),
            lambda name, key: changes[name].select(key) if name in changes else self.key_column(name, key))


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (a scan's file sizes, on any file system)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_HELD: dict[tuple[SparkSession, str], tuple[int, str | None]] = {}  # session and setting -> (blocks within, the value before)
_HELD_LOCK = threading.Lock()


@contextmanager
def held(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session with these settings; the values before come back when the last block that holds them ends."""
    with _HELD_LOCK:
        for key, value in settings.items():
            depth, before = _HELD.get((spark, key)) or (0, spark.conf.get(key, None))
            _HELD[spark, key] = (depth + 1, before)
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _HELD_LOCK:
            for key in settings:
                depth, before = _HELD.pop((spark, key))
                if depth > 1:
                    _HELD[spark, key] = (depth - 1, before)
                elif before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def read_catalog(spark: SparkSession, database: str | None = None, prefix: str = "") -> ShopTables:
    """Shop tables from catalog tables or temp views named ``[database.]<prefix><name>``.

    A deployment that loaded the shop database into its metastore (or
    registered views) reads it here; column pruning and filters reach the
    underlying scans as usual.
    """
    qual = f"{database}." if database else ""
    # A shop without a web_orders table keeps the session of an order on the order.
    names = {n: n for n in SCHEMAS}
    if not spark.catalog.tableExists(f"{qual}{prefix}web_orders"):
        names["web_orders"] = "orders"
    tables = ShopTables(**{
        name: spark.table(f"{qual}{prefix}{names[name]}").select(*cols) for name, cols in SCHEMAS.items()
    })
    summary = f"{qual}{prefix}session_summary"
    if spark.catalog.tableExists(summary) and _made_from(spark, summary) == versions.source_version(spark.table(f"{qual}{prefix}website_pageviews")):
        return tables.with_summary(spark.table(summary).select(*SESSION_SUMMARY))
    return tables


def _made_from(spark: SparkSession, summary: str) -> str | None:
    """The recorded version of the pageviews behind a catalog's summary."""
    try:
        rows = spark.sql(f"SHOW TBLPROPERTIES {summary}").collect()
    except AnalysisException:  # a view
        return None
    return {r[0]: r[1] for r in rows}.get(SUMMARY_OF)


def register_views(tables: ShopTables, prefix: str = "") -> list[str]:
    """Register every table as a temp view ``<prefix><name>`` so SQL written
    against the shop schema (e.g. the original report scripts' SELECTs) runs
    on ``spark.sql``; returns the view names."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def published_summary(spark: SparkSession, record: dict) -> DataFrame | None:
    """The summary of a commit record, if it was made from the pageviews as they are."""
    if "summary" not in record:
        return None
    pageviews = spark.read.parquet(*record["tables"]["website_pageviews"])
    if versions.source_version(pageviews) != record["summary_of"]:
        log.warning("the published session summary is older than its pageviews: not used")
        return None
    return spark.read.parquet(*record["summary"]).select(*SESSION_SUMMARY)


def read_published(spark: SparkSession, root: str) -> ShopTables:
    """Read the newest version written by :func:`shoplens.operators.prep.publish`,
    with its session summary if that is as new as the pageviews; reports
    compute it otherwise. A folder without versions is read as plain
    Parquet folders, one a table."""
    record = versions.latest(spark, root)
    if record is not None:
        tables = ShopTables(**{name: spark.read.parquet(*record["tables"][name]).select(*cols) for name, cols in SCHEMAS.items()})
        summary = published_summary(spark, record)
        return tables if summary is None else tables.with_summary(summary)

    def read(name: str, cols: list[str]) -> DataFrame:
        try:
            return spark.read.parquet(f"{root}/{name}").select(*cols)
        except AnalysisException:
            if name != "web_orders":
                raise
            return spark.read.parquet(f"{root}/orders").select(*cols)

    return ShopTables(**{name: read(name, cols) for name, cols in SCHEMAS.items()})
