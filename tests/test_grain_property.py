"""Period labels agree with plain Python date arithmetic for any timestamp
(weeks start on Monday, also across year boundaries)."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from shoplens.functions.measures import grain_columns

STAMPS = st.lists(
    st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2040, 12, 31)),
    min_size=1, max_size=200,
)


def expected(t: dt.datetime) -> tuple:
    monday = (t.date() - dt.timedelta(days=t.weekday())).isoformat()
    return (t.year, (t.month - 1) // 3 + 1, t.month, monday, t.date().isoformat())


@settings(max_examples=15, deadline=None)
@given(STAMPS)
def test_grain_labels(spark, stamps):
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    cols = [*grain_columns("t", "quarter"), grain_columns("t", "month")[1],
            *grain_columns("t", "week"), *grain_columns("t", "day")]
    got = [tuple(r) for r in df.select("t", *cols).collect()]
    assert [row[1:] for row in got] == [expected(row[0]) for row in got]
