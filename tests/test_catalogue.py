"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SPARKLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
OWN = {**entry.catalogue.QUERIES, **entry.catalogue.SESSIONS, **entry.presentation.QUERIES, **entry.filequeries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in entry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}") + 0.0
    return v


def compare(rows, columns, want, names):
    assert sorted(columns) == sorted(names)
    order = lambda rs, cs: sorted((tuple(canonical(r[cs.index(c)]) for c in sorted(cs)) for r in rs), key=repr)
    a, b = order(rows, columns), order(want, names)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-7) if all(isinstance(v, float) for v in x) else [v if not isinstance(v, float) else pytest.approx(v, rel=1e-7) for v in y] == list(x)


@pytest.mark.parametrize("name", sorted(OWN))
def test_against_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    compare([tuple(x) for x in df.collect()], df.columns, r.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
