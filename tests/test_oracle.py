"""Every query with SQL gives the same rows in Spark and in DuckDB; every other query runs."""

import duckdb
import pytest

from stratavox.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    clean = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(clean.itertuples(index=False, name=None), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_same_rows(spark, small, duck, name):
    got = plans.queries()[name](spark, small).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype != want[c].dtype and got[c].dtype != object:
            want[c] = want[c].astype(got[c].dtype)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and p == pytest.approx(q, rel=1e-6, abs=2e-6)) for p, q in zip(x, y, strict=True)), (x, y)


def test_flagship(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
