"""Every registered cube query against its SQL."""

import math

import pytest

from terncube.plans import extended  # noqa: F401  adds to the queries
from terncube.plans.queries import QUERIES, SQL


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows(df.columns, df.collect()), rows(columns, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5)


@pytest.mark.parametrize("name", ["ridge_fit", "glm_aic", "gbt_cv", "importance", "trend_bootstrap"])
def test_models_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
