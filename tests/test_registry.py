"""Every registered query against its SQL on the smallest tables."""

import functools
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from graphloom.plans import registry  # noqa: E402

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_graph():
    """The derived graph is the same for every query, so it is made once."""
    made = registry.order_graph
    registry.order_graph = functools.lru_cache(made)
    yield
    registry.order_graph = made


def plain(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted([tuple(clean(v) for v in row) for row in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = plain(tuple(row[c] for c in columns) for row in df.collect())
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = plain(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_have_finite_rows(spark, name):
    rows = registry.QUERIES[name](spark, DIR).collect()
    assert rows
    for row in rows:
        assert all(math.isfinite(v) for v in row if isinstance(v, float))
