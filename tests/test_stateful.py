"""Keyed state on streams that are stopped and resumed, against plain loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratavox.streaming import stateful


def add(spark, at, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def drain(stream, tmp_path, name="out", **trigger):
    q = stateful.started(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", **trigger)
    if trigger:
        q.awaitTermination(12)  # its clock goes on, so it doesn't end by itself
        q.stop()
    else:
        assert q.awaitTermination(120)
    return [tuple(r) for r in stream.sparkSession.read.parquet(f"{tmp_path}/{name}").collect()]


def test_a_stopped_and_resumed_stream_claims_each_folder_once(spark, tmp_path):
    schema, at = "folder string, seq long, kind string", f"{tmp_path}/in"
    r, seq, all_rows = random.Random(3), 0, []
    want, status, times = [], defaultdict(lambda: "free"), defaultdict(int)
    for _ in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            f, kind = f"f{r.randrange(12)}", r.choice(["queued", "queued", "queued", "failed", "finished", "odd"])
            rows.append((f, seq, kind))
            if kind == "queued" and status[f] == "free":
                status[f], times[f] = "claimed", times[f] + 1
                want.append((f, seq, times[f]))
            elif status[f] == "claimed" and kind in ("failed", "finished"):
                status[f] = "free" if kind == "failed" else "ready"
        rows.append((None, seq, "queued"))
        all_rows += rows
        r.shuffle(rows)
        add(spark, at, rows, schema)
        got = drain(stateful.claims(spark.readStream.schema(schema).parquet(at)), tmp_path)
        assert sorted(got) == sorted(want)
    assert sorted(drain(stateful.claims(spark.readStream.schema(schema).parquet(at)), tmp_path)) == sorted(want)


def test_maintenance_closes_once_when_its_work_is_over(spark, tmp_path):
    schema, at, start = "maintenance_id long, ts timestamp, change int", f"{tmp_path}/in", datetime(2024, 1, 1)
    minute = lambda m: start + timedelta(minutes=m)
    stream = lambda: stateful.closed_maintenance(spark.readStream.schema(schema).parquet(at), 60)
    add(spark, at, [(1, minute(0), 1), (1, minute(1), 1), (2, minute(1), 1), (1, minute(2), -1), (2, minute(3), -1), (None, minute(3), 1)], schema)
    assert drain(stream(), tmp_path) == []
    add(spark, at, [(1, minute(9), -1), (3, minute(9), 1)], schema)  # 2 was quiet for more than a minute
    assert [(r[0], r[2]) for r in drain(stream(), tmp_path)] == [(2, 1)]
    add(spark, at, [(1, minute(9.5), 1), (1, minute(9.8), -1), (3, minute(10), -1), (9, minute(30), 1)], schema)  # 1 goes on within the minute
    got = drain(stream(), tmp_path)
    assert sorted((r[0], r[2]) for r in got) == [(1, 3), (2, 1), (3, 1)]
    closed = {r.maintenance_id: r.c for r in spark.read.parquet(f"{tmp_path}/out").withColumn("c", F.date_format("completed_at", "HH:mm:ss")).collect()}
    assert closed == {1: "00:09:48", 2: "00:03:00", 3: "00:10:00"}
    add(spark, at, [(9, minute(31), -1), (8, minute(60), 1)], schema)
    assert sorted(r[0] for r in drain(stream(), tmp_path)) == [1, 2, 3, 9]


def test_failures_are_held_for_a_while_and_successes_for_good(spark, tmp_path):
    schema, at = "run_str string, seq long, steps string", f"{tmp_path}/in"
    stream = lambda: stateful.cached_listings(spark.readStream.schema(schema).parquet(at), 5)
    add(spark, at, [("a", 1, None), ("a", 2, "0,1"), ("b", 3, "0"), ("b", 4, ""), ("c", 5, "")], schema)
    clock = {"processingTime": "1 second"}
    first = {r[1]: r[2] for r in drain(stream(), tmp_path, **clock)}
    assert first == {1: "fetched", 2: "held", 3: "fetched", 4: "cached", 5: "fetched"}
    add(spark, at, [("a", 6, "0,1"), ("a", 7, None), ("b", 8, None)], schema)
    later = {r[1]: (r[2], r[3]) for r in drain(stream(), tmp_path, **clock)}
    assert later[6] == ("fetched", "0,1") and later[7] == ("cached", "0,1") and later[8] == ("cached", "0")


def test_the_store_is_set_only_while_a_stream_starts(spark):
    before = spark.conf.get(stateful._PROVIDER)
    with pytest.raises(ValueError), stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get(stateful._PROVIDER)
        raise ValueError
    assert spark.conf.get(stateful._PROVIDER) == before
