"""Each query against the same question in SQL, by another engine, over whole tables."""

import math

import pytest

from codeloom import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if hasattr(x, "tzinfo"):
            return x.replace(tzinfo=None).isoformat()
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, duck, small):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})")
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0
