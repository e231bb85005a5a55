"""Collated keys: values that a collation holds equal become one spelling.

A server whose schema has a case- and accent-insensitive collation groups,
deduplicates, joins and compares ``/Cart`` and ``/cárt`` as one value. Here the
spellings of a column are reduced to one representative each; every
report then works on plain strings (binary comparison, hash aggregates, bucketed joins).

The representative of a class is the smallest preferred spelling, if one is given
(say, the page lists a report filters on), else the smallest spelling that
occurs, in binary order. NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.sources.tables import ShopTables

#: Case- and accent-insensitive.
COLLATION = "UNICODE_CI_AI"
UTM_COLUMNS = ("utm_source", "utm_campaign", "utm_content", "device_type")


def other_spellings(df: DataFrame, column: str, collation: str = COLLATION, prefer: Sequence[str] = ()) -> DataFrame:
    """(spelling, representative) of each spelling in ``column`` that is not its own representative.

    Distinct spellings are found with a partial aggregate, so a hot value is
    one row a task; classes are then formed over spellings, not rows.
    """
    seen = df.select(F.col(column).alias("spelling")).where("spelling is not null").distinct()
    ranked = seen.select("spelling", F.lit(1).alias("rank"))
    if prefer:
        wanted = df.sparkSession.createDataFrame([(p, 0) for p in dict.fromkeys(prefer)], "spelling string, rank int")
        ranked = ranked.unionByName(wanted)
    key = F.collate("spelling", collation).alias("key")
    best = ranked.select(key, "rank", "spelling").groupBy("key").agg(F.min(F.struct("rank", "spelling"))["spelling"].alias("representative"))
    return seen.select(key, "spelling").join(best, "key").where("spelling <> representative").select("spelling", "representative")


def respelled(df: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """``df`` with the representative in place of each other spelling of ``column``; rows and columns stay."""
    lookup = spellings.select(F.col("spelling").alias("__spelling"), F.col("representative").alias("__representative"))
    joined = df.join(lookup, F.col(column) == F.col("__spelling"), "left")
    return joined.select(*[F.coalesce("__representative", c).alias(c) if c == column else F.col(c) for c in df.columns])


def collated(df: DataFrame, column: str, collation: str = COLLATION, prefer: Sequence[str] = ()) -> DataFrame:
    """``df`` with one spelling for the values of ``column`` that the collation holds equal."""
    return respelled(df, column, other_spellings(df, column, collation, prefer))


def collate_tables(tables: ShopTables, collation: str = COLLATION, pages: Sequence[str] = ()) -> ShopTables:
    """The tables with collated URL and UTM columns; ``pages`` are preferred URL spellings.

    Publish the result to pay for the look-ups once.
    """
    urls = other_spellings(tables.website_pageviews, "pageview_url", collation, pages)
    sessions = tables.website_sessions
    for column in UTM_COLUMNS:
        sessions = collated(sessions, column, collation)
    summary = tables.session_summary
    return tables.with_tables(
        website_pageviews=respelled(tables.website_pageviews, "pageview_url", urls),
        website_sessions=sessions,
        session_summary=None if summary is None else respelled(summary, "landing_url", urls),
    )
