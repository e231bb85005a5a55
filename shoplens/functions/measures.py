"""Column helpers shared by every report.

Money stays Decimal through every sum; it becomes DOUBLE only in the last
projection (:func:`money`). Ratios divide as DOUBLE and are NULL on a zero
denominator (MySQL's rule; Spark's ANSI mode would raise). Means are an
exact sum divided once by the count, so the value does not depend on the
order in which partitions are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("year", "quarter", "month", "week", "day")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Final presentation of an exact Decimal amount."""
    return col(c).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as DOUBLE; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    """``(num / den) * 100``; NULL when ``den`` is 0 or NULL."""
    return ratio(num, den) * 100


def mean(c: str | Column) -> Column:
    """AVG over non-NULL values: exact sum, one division (aggregate)."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def count_when(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END)."""
    return F.count(F.when(cond, F.lit(1)))


def grain_columns(ts: str | Column, grain: str) -> list[Column]:
    """Period key columns for ``grain``.

    year/quarter/month are INT parts; week (Monday start) and day are
    ``yyyy-MM-dd`` labels. All are computed from the wall-clock value, so
    the session time zone does not matter for TIMESTAMP_NTZ input.
    """
    t = col(ts)
    if grain == "year":
        return [F.year(t).alias("year")]
    if grain == "quarter":
        return [F.year(t).alias("year"), F.quarter(t).alias("quarter")]
    if grain == "month":
        return [F.year(t).alias("year"), F.month(t).alias("month")]
    if grain == "week":
        monday = F.date_sub(F.to_date(t), F.pmod(F.dayofweek(t) + 5, F.lit(7)))
        return [F.date_format(monday, "yyyy-MM-dd").alias("week")]
    if grain == "day":
        return [F.date_format(F.to_date(t), "yyyy-MM-dd").alias("day")]
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def grain_keys(grain: str) -> list[str]:
    return {
        "year": ["year"], "quarter": ["year", "quarter"], "month": ["year", "month"],
        "week": ["week"], "day": ["day"],
    }[grain]


def with_grain(df: DataFrame, ts: str | Column, grain: str) -> DataFrame:
    """``df`` plus the period key columns of ``grain``."""
    return df.select("*", *grain_columns(ts, grain))
