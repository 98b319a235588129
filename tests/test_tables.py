"""Optimistic commits: writers at one time lose nothing."""

import threading

import pytest
from pyspark.sql import functions as F

from stratavox.sources import tables


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.create(spark, at, "k string, n long")
    failed = []

    def work(name):
        try:
            for i in range(4):
                tables.update(spark, at, lambda t, i=i: t.unionByName(spark.createDataFrame([(name, i)], "k string, n long")))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(map(tuple, tables.load(spark, at).collect())) == [(f"w{i}", n) for i in range(4) for n in range(4)]
    assert tables.versions(spark, at) == list(range(10, 18)) and len([p for p in (tmp_path / "t").iterdir() if p.name[0] == "v"]) == 8


def test_a_stale_base_is_a_conflict_and_leaves_no_data(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.create(spark, at, "n long")
    one = tables.commit(spark.range(1).toDF("n"), at, base=1)
    assert one.count() == 1
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    with pytest.raises(tables.Conflict):
        tables.commit(spark.range(5).toDF("n"), at, base=1)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before and tables.load(spark, at).count() == 1
    assert tables.commit(spark.range(7).toDF("n"), at).count() == 7 and tables.versions(spark, at) == [2, 3]
    assert tables.load(spark, at, 2).count() == 1


def test_a_change_is_made_again_on_what_was_faster(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.create(spark, at, "n long")
    calls = []

    def change(t):
        calls.append(t.count())
        if len(calls) == 1:  # another writer comes between
            tables.update(spark, at, lambda x: x.unionByName(spark.range(10).toDF("n")))
        return t.unionByName(spark.createDataFrame([(99,)], "n long"))

    out = tables.update(spark, at, change)
    assert calls == [0, 10] and out.count() == 11 and out.filter("n = 99").count() == 1
    assert tables.create(spark, at, "n long").count() == 11
    assert tables.update(spark, at, lambda t: t.filter(F.col("n") < 3), keep=1).count() == 3
