"""Website reports.

The reference finds each session's first pageview with MIN(id) and a
self-join back to the pageviews for its URL. Here one aggregation per
session does it (``min_by``), with map-side partial aggregation, so a
session with a huge number of pageviews does not land in one task. The
funnel counts stage pageviews per session first and joins the per-session
counts to the sessions, so the session join sees one row per session
rather than one per pageview. Reports that need only per-session facts
take an optional precomputed ``summary`` (published next to the tables by
:func:`shoplens.operators.prep.publish`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.measures import count_when, grain_keys, money, pct, ratio, with_grain

# The reference's landing pages, active cutoff and funnel
# stages (stage name, pages), in funnel order.
LANDING_PAGES = ["/home", "/lander-1", "/lander-2", "/lander-3", "/lander-4", "/lander-5"]
ACTIVE_CUTOFF = "2015-03-01 00:00:00"
FUNNEL_STAGES: list[tuple[str, list[str]]] = [
    ("lander", LANDING_PAGES),
    ("product", ["/products", "/high-score-hoodie", "/power-up-pants", "/cheat-code-cap", "/side-quest-shirt"]),
    ("cart", ["/cart"]),
    ("shipping", ["/shipping"]),
    ("billing", ["/billing", "/billing-2"]),
    ("thanks", ["/thank-you-for-your-order"]),
]


def session_summary(pageviews: DataFrame) -> DataFrame:
    """Per session: first pageview id, its URL, first time and pageview count."""
    return pageviews.groupBy("website_session_id").agg(
        F.min("website_pageview_id").alias("first_pageview_id"),
        F.min_by("pageview_url", "website_pageview_id").alias("landing_url"),
        F.min("created_at").alias("first_pageview_visited"),
        F.count("website_pageview_id").alias("session_pageviews"),
    )


def merge_summaries(one: DataFrame, other: DataFrame) -> DataFrame:
    """The summary of two sets of pageviews together, from their summaries."""
    return one.unionByName(other).groupBy("website_session_id").agg(
        F.min("first_pageview_id").alias("first_pageview_id"),
        F.min_by("landing_url", "first_pageview_id").alias("landing_url"),
        F.min("first_pageview_visited").alias("first_pageview_visited"),
        F.sum("session_pageviews").alias("session_pageviews"),
    )


def _summary(pageviews: DataFrame, summary: DataFrame | None) -> DataFrame:
    return summary if summary is not None else session_summary(pageviews)


def sessions_by_period(sessions: DataFrame, grain: str = "year") -> DataFrame:
    """Sessions per period."""
    keys = grain_keys(grain)
    return with_grain(sessions, "created_at", grain).groupBy(*keys).agg(
        F.count("website_session_id").alias("sessions"))


def page_first_view(pageviews: DataFrame) -> DataFrame:
    """First pageview id and time of every page."""
    return pageviews.groupBy("pageview_url").agg(
        F.min("website_pageview_id").alias("first_pageview_id"),
        F.min("created_at").alias("first_visited"))


def page_lifetime(pageviews: DataFrame) -> DataFrame:
    """Every page's first view, birth year and lifetime pageviews, oldest first."""
    agg = pageviews.groupBy("pageview_url").agg(
        F.min("website_pageview_id").alias("first_pageview_id"),
        F.min("created_at").alias("first_visited"),
        F.count("website_pageview_id").alias("pageviews"))
    return agg.select(
        "pageview_url", "first_pageview_id", "first_visited",
        F.year("first_visited").alias("year_created"), "pageviews",
    ).orderBy("first_visited")


def entry_pages(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Sessions per landing page, largest first."""
    return _summary(pageviews, summary).groupBy(F.col("landing_url").alias("pageview_url")).agg(
        F.count("website_session_id").alias("sessions")).orderBy(F.col("sessions").desc())


def session_landing(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Landing pageview of every session."""
    return _summary(pageviews, summary).select(
        "website_session_id", "first_pageview_id", "first_pageview_visited",
        F.col("landing_url").alias("pageview_url"))


def landing_pages(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Distinct landing pages."""
    return _summary(pageviews, summary).select(F.col("landing_url").alias("pageview_url")).distinct()


def session_pageview_counts(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Pageviews per session with its first pageview id."""
    # The NULL session joins no pageviews: its count is 0.
    n = F.when(F.col("website_session_id").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("session_pageviews"))
    return _summary(pageviews, summary).select(
        "website_session_id", "first_pageview_id", n.alias("session_pageviews"))


def landing_bounce_rate(pageviews: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """W4d: single-pageview sessions, sessions and bounce rate (%) per landing page."""
    s = _summary(pageviews, summary)
    agg = s.groupBy(F.col("landing_url").alias("pageview_url")).agg(
        count_when((F.col("session_pageviews") == 1) & F.col("website_session_id").isNotNull()).alias("bounces"),
        F.count("website_session_id").alias("sessions"))
    return agg.select(
        "pageview_url", "bounces", "sessions", pct("bounces", "sessions").alias("bounce_rate"),
    ).orderBy(F.col("bounces").desc())


def last_order(orders: DataFrame) -> DataFrame:
    """Time of the last order."""
    return orders.agg(F.max("created_at").alias("last_recorded_order"))


def landing_status(
    pageviews: DataFrame, cutoff: str = ACTIVE_CUTOFF, urls: Sequence[str] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Latest pageview of each landing page and ACTIVE when it is after
    ``cutoff``. ``urls=None`` uses the pages that landed a session (W4b)
    instead of a pasted list (SURVEY Q18). One row per page (Q7)."""
    if urls is None:
        # Filter on the group key after aggregating: both semi-join sides are
        # then one row per URL, so a hot URL never meets a shuffle join.
        latest = pageviews.groupBy("pageview_url").agg(F.max("created_at").alias("latest_pageview"))
        latest = latest.join(landing_pages(pageviews, summary), "pageview_url", "left_semi")
    else:
        latest = pageviews.where(F.col("pageview_url").isin(list(urls))).groupBy("pageview_url").agg(
            F.max("created_at").alias("latest_pageview"))
    status = F.when(F.col("latest_pageview") > F.lit(cutoff).cast("timestamp_ntz"), "ACTIVE").otherwise("INACTIVE")
    return latest.select("pageview_url", "latest_pageview", status.alias("status")).orderBy("status")



def landing_status_rows(
    pageviews: DataFrame, cutoff: str = ACTIVE_CUTOFF, urls: Sequence[str] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """``landing_status`` with the rows that the script's join on the time gives for each page
    (``literal_rows``): one per pageview, of whatever page, at the page's latest time; one where there is none (SURVEY Q7).

    Pageviews before the earliest of those times are left out at the scan;
    the others are counted per time before they meet the pages.
    """
    status = landing_status(pageviews, cutoff, urls, summary)
    earliest = status.agg(F.min("latest_pageview")).scalar()
    views = pageviews.where(F.col("created_at") >= earliest).groupBy(F.col("created_at").alias("_time")).agg(
        F.count(F.lit(1)).alias("_views"))
    return status.join(views, F.col("latest_pageview") == F.col("_time"), "left").select(
        "pageview_url", "latest_pageview", "status", F.coalesce("_views", F.lit(1)).alias("literal_rows"))

def traffic_tuples(sessions: DataFrame) -> DataFrame:
    """Distinct traffic source tuples."""
    return sessions.select("utm_source", "utm_campaign", "utm_content", "device_type").distinct()


def paid_share(sessions: DataFrame) -> DataFrame:
    """Sessions and paid / unpaid share (%) (NULL utm_source = unpaid)."""
    agg = sessions.agg(
        F.count("website_session_id").alias("website_sessions"),
        count_when(F.col("utm_source").isNotNull()).alias("paid"),
        count_when(F.col("utm_source").isNull()).alias("unpaid"))
    return agg.select(
        "website_sessions",
        pct("paid", "website_sessions").alias("pct_paid_traffic"),
        pct("unpaid", "website_sessions").alias("pct_unpaid_traffic"))


def campaigns(sessions: DataFrame) -> DataFrame:
    """Distinct campaigns (NULL = unpaid)."""
    return sessions.select("utm_campaign").distinct()


def _label(keys: list[str]) -> list:
    return [F.col(k).cast("string").alias(k) if k == "year" else F.col(k) for k in keys]


def campaign_sessions(sessions: DataFrame, grain: str = "year") -> DataFrame:
    """Sessions per campaign and period (NULL campaign kept; year as a label)."""
    keys = grain_keys(grain)
    agg = with_grain(sessions, "created_at", grain).groupBy("utm_campaign", *keys).agg(
        F.count("website_session_id").alias("website_sessions"))
    return agg.select("utm_campaign", *_label(keys), "website_sessions")


def campaign_revenue(sessions: DataFrame, orders: DataFrame, grain: str = "year") -> DataFrame:
    """W7 companion (Q17): campaigns as revenue drivers: sessions, orders and
    revenue per campaign and period, orders attributed by session."""
    keys = grain_keys(grain)
    per_session = orders.groupBy("website_session_id").agg(
        F.count("order_id").alias("n_orders"), F.sum("price_usd").alias("revenue"))
    j = with_grain(sessions, "created_at", grain).join(per_session, "website_session_id", "left")
    agg = j.groupBy("utm_campaign", *keys).agg(
        F.count("website_session_id").alias("website_sessions"),
        F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"),
        F.sum("revenue").alias("revenue"))
    return agg.select(
        "utm_campaign", *_label(keys), "website_sessions", "orders",
        money("revenue").alias("revenue"),
        ratio("revenue", "website_sessions").alias("revenue_per_session"))


def paid_sources(sessions: DataFrame) -> DataFrame:
    """Sessions per paid traffic source."""
    return sessions.where(F.col("utm_source").isNotNull()).groupBy("utm_source").agg(
        F.count("website_session_id").alias("website_sessions"))


def order_rate(sessions: DataFrame, orders: DataFrame, grain: str = "month") -> DataFrame:
    """Orders per session (%) by session period. As in the reference a
    session with k orders counts k times on both sides (Q22)."""
    keys = grain_keys(grain)
    per_session = orders.where(F.col("website_session_id").isNotNull()).groupBy(
        "website_session_id").agg(F.count(F.lit(1)).alias("n_orders"))
    j = with_grain(sessions, "created_at", grain).join(per_session, "website_session_id", "left")
    rows = F.when(F.col("website_session_id").isNotNull(), F.greatest(F.coalesce("n_orders", F.lit(0)), F.lit(1)))
    agg = j.groupBy(*keys).agg(
        F.coalesce(F.sum("n_orders"), F.lit(0)).alias("o"), F.coalesce(F.sum(rows), F.lit(0)).alias("s"))
    return agg.select(*keys, pct("o", "s").alias("order_rate"))


def distinct_urls(pageviews: DataFrame) -> DataFrame:
    """Distinct page URLs."""
    return pageviews.select("pageview_url").distinct()


def url_pageviews(pageviews: DataFrame) -> DataFrame:
    """Pageviews per URL, most first (the value profile before recoding)."""
    return pageviews.groupBy("pageview_url").agg(
        F.count("website_pageview_id").alias("pageviews")).orderBy(F.col("pageviews").desc())


def session_pageviews(pageviews: DataFrame) -> DataFrame:
    """Every pageview of every session. The reference joins each
    session's first id back to its pageviews and never uses the id; the
    result is the pageviews themselves, so no join is run. Pageviews without
    a session form one group that joins nothing: one all-NULL row."""
    sid = F.col("website_session_id")
    known = pageviews.where(sid.isNotNull()).select("website_session_id", "website_pageview_id", "pageview_url")
    lost = pageviews.where(sid.isNull()).groupBy("website_session_id").agg(
        F.max(F.when(sid.isNotNull(), F.col("website_pageview_id"))).alias("website_pageview_id"),
        F.max(F.when(sid.isNotNull(), F.col("pageview_url"))).alias("pageview_url"))
    return known.union(lost)


def _funnel(pageviews, sessions, stages, grain, unit):
    keys = grain_keys(grain)
    url = F.col("pageview_url")
    # Pageviews without a session reach no stage but keep their (NULL) period's row.
    known = F.col("website_session_id").isNotNull()
    per_session = pageviews.groupBy("website_session_id").agg(
        *[count_when(known & url.isin(list(urls))).alias(f"_{name}") for name, urls in stages])
    periods = with_grain(sessions, "created_at", grain).select("website_session_id", *keys)
    j = per_session.join(periods, "website_session_id", "left")
    suffix = "pvws" if unit == "pageview" else "sessions"
    if unit == "pageview":
        measures = [F.sum(f"_{name}") for name, _ in stages]
    else:
        measures = [count_when(F.col(f"_{name}") > 0) for name, _ in stages]
    agg = j.groupBy(*keys).agg(*[m.cast("bigint").alias(f"{n}_{suffix}") for m, (n, _) in zip(measures, stages)])
    cols = [f"{name}_{suffix}" for name, _ in stages]
    out = [*keys, cols[0]]
    for i in range(1, len(cols)):
        out += [pct(cols[i], cols[i - 1]).alias(f"conversion{i + 1}"), cols[i]]
    return agg.select(*out)


def funnel(
    pageviews: DataFrame, sessions: DataFrame,
    stages: Sequence[tuple[str, Sequence[str]]] = FUNNEL_STAGES, grain: str = "month",
) -> DataFrame:
    """W10d: pageviews per funnel stage and step-to-step conversion (%) per
    session period. Counts pageviews, so a reload counts twice and a
    conversion can exceed 100 % (Q16)."""
    return _funnel(pageviews, sessions, stages, grain, "pageview")


def funnel_sessions(
    pageviews: DataFrame, sessions: DataFrame,
    stages: Sequence[tuple[str, Sequence[str]]] = FUNNEL_STAGES, grain: str = "month",
) -> DataFrame:
    """W10 companion (Q16): sessions reaching each stage and conversion (%)."""
    return _funnel(pageviews, sessions, stages, grain, "session")
