"""Registered queries against their SQL in DuckDB.

By default every ninth query is run; ALL_QUERIES=1 runs all.
"""

import math
import os

import duckdb
import pytest

from terracell.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else sorted(SQL)[::9]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return c


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if v else "0"
    return str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(x[names.index(c)] for c in columns) for x in r.fetchall()]
    key = lambda row: tuple((not isinstance(v, float), canonical(v)) for v in sorted(row, key=lambda v: isinstance(v, float)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(close, a, b))]
    assert not bad, bad[:3]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).limit(1).count() == 1
