"""Every registered report equals its DuckDB twin on the sf0.01 fixtures."""

from __future__ import annotations

import pytest
from places import SF_ORACLE
from oracle_compare import compare, duck_connect

import __spark_entry__ as entry
from shoplens.plans.reports import REPORTS

NAMES = sorted(REPORTS)


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(REPORTS) <= set(entry.queries()) and set(REPORTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_ORACLE)
    ok, msg = compare(df, entry.oracle_sql()[name], duck)
    assert ok, msg
