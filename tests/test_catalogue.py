"""Every query against DuckDB over the same small tables."""

import duckdb
import pytest

from tessera.catalogue import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    q = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in q.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in order) for r in q.fetchall()), key=repr)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship" in e.queries()
