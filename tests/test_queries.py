"""Every registered query against its SQL on the smallest tables, as the driver does on larger ones."""

import os

import duckdb
import pytest

from tidemark.plans import backfills, catalog, checks, fits, more, serving, stored  # noqa: F401

FOLDER = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return db


def shown(v):
    return "" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == sorted(tuple(shown(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
