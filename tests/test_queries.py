"""Every registered query runs on the smallest tables; SQL-expressible ones
match their DuckDB oracle (row count, column names, values)."""

import math
from collections import Counter

import duckdb
import pytest

from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    import __spark_entry__ as ent

    df = ent.entry(spark)
    assert df.columns == ["year", "station", "precip"]
    assert df.count() > 0
    assert set(ent.oracle_sql()) <= set(ent.queries())


def _names():
    from pluvio.plans.catalog import REGISTRY

    return sorted(REGISTRY)


@pytest.mark.parametrize("name", _names())
def test_query_against_oracle(spark, con, name):
    from pluvio.plans.catalog import REGISTRY

    e = REGISTRY[name]
    df = e.build(spark, SMALL)
    rows = df.collect()
    if e.sql is None:
        assert len(df.columns) > 0
        return
    cur = con.execute(e.sql)
    cols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    order = sorted(cols)
    a = Counter(tuple(_norm(r[df.columns.index(c)]) for c in order) for r in rows)
    b = Counter(tuple(_norm(r[cols.index(c)]) for c in order) for r in drows)
    assert a == b
