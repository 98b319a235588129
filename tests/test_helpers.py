"""Helpers that no query over the driver's tables reaches: names, times, crops, older interpolation, stream sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratavox.functions import geo, interp, text
from stratavox.operators import bc4, catalog, stats
from stratavox.sources import cube
from stratavox.streaming import progress

from .test_functions import one, pchip


def test_names_and_times(spark):
    assert one(spark, text.iso_time(F.lit("1995-06-13T09:00:00Z"))) == dt.datetime(1995, 6, 13, 9)
    assert one(spark, text.iso_time(F.lit("13 June"))) is None
    parts = one(spark, text.folder_parts(F.lit("1995061309_042")))
    assert (parts.run_ts, parts.step) == (dt.datetime(1995, 6, 13, 9), 42)
    assert one(spark, text.folder_parts(F.lit("1995061309_42"))) is None
    assert one(spark, text.folder_parts(F.lit(None).cast("string"))) is None


def test_pixels_in_metres_count_rows_downwards(spark):
    at = one(spark, geo.pixel_metres(F.lit(3), F.lit(2), F.lit(1000.0), F.lit(500.0), F.lit(10.0)))
    assert (at.x, at.y) == (1030.0, 480.0)


def test_older_interpolation(spark):
    z, v = [90.0, 60.0, 40.0, 0.0], [1.0, 3.0, 4.0, 9.0]
    plain = lambda z: one(spark, interp.pchip_plain([F.lit(a) for a in z], [F.lit(a) for a in v], F.lit(50.0)))
    assert plain(z) == pytest.approx(pchip(z, v, 50.0))
    assert plain([90.0, 50.0, 50.0, 0.0]) is None


def test_timings_keep_the_last_of_each_name(spark):
    log = "".join(f"Step {i % 50} completed in {i}.00s\n" for i in range(2000))
    assert one(spark, text.timing_map(F.lit(log))) == {f"step_{i}": 1950.0 + i for i in range(50)}
    assert one(spark, text.timing_map(F.lit(""))) == {}
    assert one(spark, text.timing_map(F.lit(None).cast("string"))) is None


def test_crop_and_order(spark):
    grid = spark.createDataFrame([("t", 0, y, x, float(y * 4 + x)) for y in range(3) for x in range(4)], "var string, level int, iy int, ix int, value double")
    lat = spark.createDataFrame([(y, 46.0 + y) for y in range(3)], "iy int, lat double")
    lon = spark.createDataFrame([(x, 10.0 + x) for x in range(4)], "ix int, lon double")
    kept = cube.cropped(grid, lat, lon, 46.5, 48.0, 11.0, 12.0)
    assert sorted((r.iy, r.ix) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert cube.cropped(grid, lat, lon, 0.0, 1.0, 11.0, 12.0).count() == 0
    files = spark.createDataFrame([("t", "b", 7), ("t", "a", 3), ("p", "c", 65)], "var string, file string, level int")
    assert {(r.var, r.level): r.z for r in cube.by_order(files).collect()} == {("t", 3): 0, ("t", 7): 1, ("p", 65): 0}


def test_tee_writes_every_line(spark, tmp_path):
    lines = spark.createDataFrame([(1, "one"), (2, "PROGRESS::lod::a::5"), (2, "")], "key long, line string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    progress.tee(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\tone", "2\t", "2\tPROGRESS::lod::a::5"]


def test_maintenance_closes_once_its_sets_are_done(spark, tmp_path):
    start = dt.datetime(1995, 6, 13, 9)
    names = "id long, label string, started_at timestamp, completed_at timestamp, added array<string>, purged array<string>, renewed array<string>"
    maintenance = spark.createDataFrame([(1, "A", start, None, ["x"], [], []), (2, "B", start, None, [], [], []), (3, "C", start, start, [], [], [])], names)
    tilesets = spark.createDataFrame([(1, "x", "failed"), (2, "y", "pending")], "maintenance_id long, folder string, status string")
    spark.range(1).write.parquet(str(tmp_path / "in"))
    saved = []
    finished = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    now = start + dt.timedelta(minutes=90)
    progress.close_maintenance(finished, lambda: (maintenance, tilesets), lambda df: saved.extend(df.collect()), lambda: now, str(tmp_path / "state")).start().awaitTermination()
    assert [(r.id, r.completed_at) for r in saved] == [(1, now)]
    assert "90.0 min" in saved[0].summary and "failed (x)" in saved[0].summary


def test_volumes_of_blocks_are_checked_and_read_by_whole_blocks(spark):
    """Sides are padded when written; only whole blocks are read; gaps, repeats and values that are no numbers are errors."""
    texels = [(0, y, x, float((y * 7 + x * 3) % 5) * 8) for y in range(6) for x in range(9)]
    schema = "z int, vy int, vx int, density double"
    packed = bc4.encode_volume(spark.createDataFrame(texels, schema), 6, 9, ["z"])
    assert {(r.by, r.bx, len(r.content)) for r in packed.collect()} == {(y, x, 8) for y in range(2) for x in range(3)}
    back = {(r.vy, r.vx): r.value for r in bc4.decode_volume(packed, 6, 9, ["z"]).collect()}
    assert set(back) == {(y, x) for y in range(4) for x in range(8)}
    assert all(abs(back[y, x] - v / 32) < 0.08 for _, y, x, v in texels if (y, x) in back)
    assert bc4.decode_volume(packed, 3, 9, ["z"]).count() == 0
    for bad in (texels[1:], [*texels, texels[0]], [(0, 0, 0, float("nan")), *texels[1:]], [(0, 0, 0, None), *texels[1:]]):
        with pytest.raises(Exception, match="block"):
            bc4.encode_volume(spark.createDataFrame(bad, schema), 6, 9, ["z"]).collect()
    with pytest.raises(ValueError, match="sides"):
        bc4.encode_volume(spark.createDataFrame(texels, schema), 0, 9, ["z"])


def test_pictures_are_shrunk_in_proportion(spark):
    assert [stats.shrunk_side(*x, 100) for x in ((80, 100), (400, 200), (200, 400), (1, 1000))] == [(80, 100), (100, 50), (50, 100), (1, 100)]
    flat = spark.range(40 * 20).selectExpr("cast(id div 20 as int) py", "cast(id % 20 as int) px", "117 grey")
    small = stats.shrunk(flat, 40, 20, 10).collect()
    assert {(r.py, r.px) for r in small} == {(y, x) for y in range(10) for x in range(5)} and {r.grey for r in small} == {117}
    assert stats.shrunk(flat, 40, 20, 40).count() == 800


def test_first_valid_and_structure(spark):
    rows = spark.createDataFrame([(1, 3, "c", True), (1, 1, "a", False), (1, 2, None, True), (2, 1, "x", False)], "k int, i int, v string, ok boolean")
    assert {r.k: r.v for r in catalog.first_valid(rows, ["k"], "i", "v", F.col("ok") & F.col("v").isNotNull(), "-").collect()} == {1: "c", 2: "-"}
    messages = spark.createDataFrame([("t", "surface", 0), ("t", "surface", 0), ("u", "surface", 1), ("t", "other", 1)], "short_name string, type_of_level string, level int")
    assert [(r.type_of_level, r.n, [tuple(v) for v in r.variables]) for r in stats.structure(messages).collect()] == [("surface", 2, [("t", 1), ("u", 1)])]
