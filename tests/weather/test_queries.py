"""Every registered weather query against its SQL, at the smallest scale; those without SQL must run and give rows."""

from __future__ import annotations

import datetime
import math

import pytest

from fieldweave.jobs import load

from .conftest import SF

QUERIES, ORACLES = load()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-4 + 1e-6 * abs(b)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "~", round(x, 2)) for x in r)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(all(map(same, g, w)) for g, w in zip(got, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
