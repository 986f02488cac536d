"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from larder import queries, queries_app, queries_text  # noqa: F401  they register themselves

SF = os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in row)


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    want = sorted((rounded(r) for r in want.select(", ".join(columns)).fetchall()), key=key)
    assert sorted((rounded(r) for r in df.select(*columns).collect()), key=key) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1
