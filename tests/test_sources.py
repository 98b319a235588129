"""Files written and read again."""

import bz2

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators.components import components
from stratavox.sources import cube, fetch, ktx2, logs, raw_tiles, tables
from stratavox.streaming import progress


@pytest.mark.parametrize(("name", "shape", "kind", "compress"), [("R32_SFLOAT", (4, 8, 8, 1), "f4", True), ("R8G8_UNORM", (4, 8, 8, 2), "u1", False), ("R8G8B8_UNORM", (3, 8, 8, 3), "u1", True), ("R16_SFLOAT", (2, 6, 5, 1), "f2", False), ("R8_SNORM", (2, 4, 4, 1), "i1", True)])
def test_container_round_trip(name, shape, kind, compress):
    data = (np.random.default_rng(1).uniform(0, 100, shape)).astype(kind)
    head, mips, pairs = ktx2.decode(ktx2.encode([data], name, (shape[2], shape[1], shape[0]), {"Author": "me", "metadata": '{"a": 1}'}, compress=compress))
    assert (head["format"], head["width"], head["height"], head["depth"]) == (name, shape[2], shape[1], shape[0])
    assert mips[0] == data.tobytes() and pairs["Author"] == "me" and pairs["a"] == 1
    assert len(ktx2.FORMATS) == 26 and ktx2.NAMES[139] == "BC4_UNORM_BLOCK"


def test_container_layout_and_mips():
    levels = [np.full((1, 16 >> i, 16 >> i, 4), 7 * i, "u1") for i in range(3)]
    data = ktx2.encode(levels, "R8G8B8A8_UNORM", (16, 16, 1))
    import struct

    index = [struct.unpack_from("<3Q", data, 80 + 24 * i) for i in range(3)]
    assert index[2][0] < index[1][0] < index[0][0] and index[2][0] % 16 == 0
    assert [len(m) for m in ktx2.decode(data)[1]] == [1024, 256, 64]
    assert ktx2.texels(np.array([[[1.5], [0.5]]]), "R8_UNORM").tolist() == [[[255], [127]]]
    with pytest.raises(ValueError):
        ktx2.block_payload(b"123", 8, 8, 1, "BC4_UNORM_BLOCK")
    with pytest.raises(ValueError):
        ktx2.decode(b"nothing")


def test_files_read_by_spark(spark, tmp_path):
    (tmp_path / "tile_10_5_6.ktx2").write_bytes(ktx2.encode([np.ones((2, 4, 4, 1), "f4")], "R32_SFLOAT", (4, 4, 2), {"val_scale": 32}, compress=True))
    row = ktx2.read(spark, str(tmp_path)).first()
    assert row["format"] == "R32_SFLOAT" and row["metadata"]["val_scale"] == "32" and len(row["mips"][0]) == 128
    head = dict(zip(raw_tiles.FIELDS, (1.5, 1.5, 218.75, 10, 7, 8), strict=True))
    (tmp_path / "tile_10_7_8.raw.zst").write_bytes(raw_tiles.encode(head, np.arange(16, dtype=np.float32)))
    tiles = raw_tiles.read(spark, str(tmp_path))
    assert tiles.first()["density"] == [float(i) for i in range(16)]
    assert {(r.vz, r.vy, r.vx): r.density for r in raw_tiles.voxels(tiles, 2, 4).collect()}[1, 1, 3] == 15.0
    assert sorted((r.x, r.y) for r in raw_tiles.leaves(spark, str(tmp_path), 10).collect()) == [(5, 6), (7, 8)]


def test_fetch_keeps_what_is_there(spark, tmp_path):
    kept = tmp_path / "kept.grib2"
    kept.write_bytes(b"old")
    tasks = spark.createDataFrame([("ok", str(tmp_path / "new.grib2")), ("bad", str(tmp_path / "none.grib2")), ("ok", str(kept))], "url string, path string")

    def load(url):
        if url == "bad":
            raise OSError("no such file")
        return bz2.compress(b"data")

    got = {r.path.rsplit("/", 1)[1]: (r["size"], r.error) for r in fetch.fetch(tasks, 2, load).collect()}
    assert got["new.grib2"] == (4, None) and got["kept.grib2"][0] == 3 and got["none.grib2"][1] == "no such file"
    assert kept.read_bytes() == b"old"


def test_cube_stack_and_completion(spark):
    from stratavox.schemas import variables

    fields = spark.createDataFrame([("a/qc_1.grib2", 0, 0, 1.5), ("a/clct.grib2", 0, 0, 9.0)], "file string, iy int, ix int, value double")
    c = cube.stacked(fields)
    assert [(r["var"], r.level, r.value) for r in c.collect()] == [("qc", 1, 1.5)]
    full = cube.complete(c, variables(spark), ["qc"], spark.createDataFrame([(0, 0)], "iy int, ix int"))
    assert full.count() == 65 and full.agg(F.sum("value")).first()[0] == 1.5
    assert cube.slots(c, variables(spark)).first()["z"] == 0


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "table")
    assert tables.create(spark, path, "id long, msg string").count() == 0
    for i in range(3):
        tables.commit(spark.createDataFrame([(i, "x")], "id long, msg string"), path)
    assert tables.versions(spark, path) == [3, 4] and tables.load(spark, path).first()["id"] == 2


def test_logs(spark, tmp_path):
    (tmp_path / "latest.log").write_text("Download completed in 3.25s\n")
    assert logs.timings(logs.read(spark, str(tmp_path))).first()["total"] == 3.25


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()))
    assert {got[i] for i in range(101, 161)} == {100} and {got[i] for i in range(6, 30)} == {5} and 5 not in got


def test_queue_stream(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "id long").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    progress.drain(stream, lambda batch: seen.extend(r.id for r in batch.collect()), str(tmp_path / "state")).start().awaitTermination()
    assert sorted(seen) == list(range(5))
