"""Every query against its SQL, over the smallest scale."""

import os

import pytest

from readsieve.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def normal(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{DATA}/orders.parquet'")
    return con


def test_names():
    assert set(oracle.oracle_sql()) == set(queries.queries()) - {"score_random"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = db.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == want


def test_random_scores_repeat(spark):
    a, b = ({tuple(r) for r in queries.score_random(spark, DATA).collect()} for _ in range(2))
    assert a == b and all(8192 - 16384 <= s <= 24575 for _, s in a)
