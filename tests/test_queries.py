"""Each linkage query against its SQL."""

import os

import duckdb
import pytest

from privlink import queries as q

SF = "/root/testdata/sf0.001"
SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}{'/*.parquet' if os.path.isdir(f'{SF}/{name}') else ''}'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    pairs = __spark_entry__.entry(spark).collect()
    assert sum(r.aid == r.bid for r in pairs) >= 190
