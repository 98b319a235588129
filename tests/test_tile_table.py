"""Tiles by folder, zoom and x: what is read for a request, and what stays when a part is written again."""

import re

from stratavox.sources import tile_table

SCHEMA = "folder string, zoom int, x int, row int, content binary"


def test_a_request_reads_one_folder(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = [(f"2024010100_{s:03d}", z, x, r, f"{s} {z} {x} {r}".encode()) for s in (0, 3) for z in (9, 10) for x in range(5) for r in range(6)]
    tile_table.save(spark.createDataFrame(rows, SCHEMA), at, spread=2)
    found = tile_table.one(spark, at, "2024010100_003/tiles/10/4/5.ktx2")
    assert [bytes(r.content) for r in found.collect()] == [b"3 10 4 5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "zoom" in filters and "x#" in filters and "folder" in filters and re.search(r"PushedFilters: \[[^\]]*EqualTo\(row,5\)", plan)
    for wrong in ("2024010100_003/tiles/10/4/6.ktx2", "../etc/passwd", "2024010100_003/tiles/10/4/5.ktx2x", ""):
        assert tile_table.one(spark, at, wrong).count() == 0
    asked = spark.createDataFrame([("2024010100_000/tiles/9/0/1.ktx2",), ("2024010100_000/tiles/9/0/1.ktx2",), ("no",), ("2024010100_009/tiles/9/0/1.ktx2",)], "path string")
    assert sorted((r.path, r.content and bytes(r.content)) for r in tile_table.many(asked, at).collect()) == [("2024010100_000/tiles/9/0/1.ktx2", b"0 9 0 1")] * 2 + [("2024010100_009/tiles/9/0/1.ktx2", None), ("no", None)]


def test_only_what_is_written_again_is_replaced(spark, tmp_path):
    at = str(tmp_path / "t")
    f = "2024010100_003"
    tile_table.save(spark.createDataFrame([(f, 9, x, r, b"old") for x in range(3) for r in range(3)], SCHEMA), at)
    tile_table.save(spark.createDataFrame([(f, 9, 1, 7, b"new")], SCHEMA), at)
    got = sorted((r.x, r.row, bytes(r.content)) for r in tile_table.load(spark, at).collect())
    assert got == [(0, r, b"old") for r in range(3)] + [(1, 7, b"new")] + [(2, r, b"old") for r in range(3)]
