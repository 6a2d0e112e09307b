"""Every registered query with an SQL oracle matches DuckDB on the small tables."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_has_entry_point():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 90


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["p_brand", "count", "event_rate"]
    assert df.count() >= 0
