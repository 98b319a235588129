"""Files that are committed as a whole, encoded pyramids and shadow maps in bands."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import lod, stencil
from stratavox.sources import ktx2, sinks, tile_store

VOXELS = "zoom int, tx int, ty int, vz int, vy int, vx int, density double"


def there(at):
    return {os.path.relpath(os.path.join(d, f), at): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(at) for f in names if f[0] != "."}


def files(spark, pairs):
    return spark.createDataFrame([(p, c) for p, c in pairs], "path string, content binary").repartition(3)


def test_a_job_commits_or_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "store")
    tile_store.save(files(spark, [(f"a/{i}.bin", bytes([i]) * 10) for i in range(20)]), at)
    first = there(at)
    assert len(first) == 20 and first["a/7.bin"] == b"\7" * 10
    late = files(spark, [(f"b/{i}.bin", b"x") for i in range(50)] + [("a/3.bin", b"new")]).withColumn("path", F.when(F.col("path") == "b/49.bin", F.raise_error("broken").cast("string")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="broken"):
        tile_store.save(late, at)
    assert there(at) == first
    tile_store.save(files(spark, [("a/3.bin", b"new"), ("c/d/e.bin", b"deep")]), at)
    assert there(at) == first | {"a/3.bin": b"new", "c/d/e.bin": b"deep"}
    tile_store.save(files(spark, [("only.bin", b"1")]), at, "overwrite")
    assert there(at) == {"only.bin": b"1"}
    tile_store.save(files(spark, []), at)
    assert there(at) == {"only.bin": b"1"}


@pytest.mark.parametrize("path", ["", "../x", "/x", "_x", "a/../../x", None])
def test_paths_outside_the_folder_are_refused(spark, tmp_path, path):
    with pytest.raises(Exception):
        tile_store.save(files(spark, [("ok", b"1"), (path, b"2")]), str(tmp_path / "store"))
    assert not there(str(tmp_path))


def test_a_commit_that_fails_is_undone(tmp_path):
    import pyarrow as pa

    root = tmp_path / "store"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1").write_bytes(b"old")
    (root / "blocked").write_bytes(b"a file where a folder should be")
    writer = tile_store.TileWriter(str(root), False)
    message = writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a/1", "a/2", "blocked/3"], "content": [b"new", b"new", b"new"]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))]))
    before = {k: v for k, v in there(str(root)).items() if not k.startswith("_")}
    with pytest.raises(OSError):
        writer.commit([message, None])
    writer.abort([message])
    assert there(str(root)) == before == {"a/1": b"old", "blocked": b"a file where a folder should be"}


def test_encoded_pyramid_of_sides_that_blocks_do_not_divide(spark, tmp_path):
    r = np.random.default_rng(3)
    cells = [(3, 1, 2, int(z), int(y), int(x), float(v)) for (z, y, x), v in np.ndenumerate(r.uniform(0, 40, (3, 6, 6))) if r.random() < 0.8] + [(3, 4, 4, 0, 5, 5, 9.0)]
    sinks.lod_tile_files(spark.createDataFrame(cells, VOXELS), str(tmp_path / "t"), 3, 6, (1.0, 1.0, 5.0), 4, least=1)
    rows = {r.path.split("/t/")[1]: r for r in ktx2.read(spark, str(tmp_path / "t")).collect()}
    assert set(rows) == {"3/1/5.ktx2", "3/4/3.ktx2"}
    row = rows["3/1/5.ktx2"]
    assert [len(m) for m in row.mips] == [2 * 2 * 8 * 3, 8, 8] and row.metadata["phys_res_x"] == "2.0" and row.metadata["tile_y"] == "5"
    whole = np.zeros((3, 6, 6))
    for z, tx, ty, vz, vy, vx, v in cells[:-1]:
        whole[vz, 5 - vy, vx] = v
    for size, df in lod.tile_mips(spark.createDataFrame(cells, VOXELS).filter("tx = 1").withColumn("vy", 5 - F.col("vy")), 3, 6, 1):
        got = np.zeros(size)
        for c in df.collect():
            got[c.vz, c.vy, c.vx] = c.density
        assert np.allclose(got, whole)
        z, y, x = (max(1, s // 2) for s in size)
        cut = whole[: z * 2 if size[0] > 1 else 1, : y * 2 if size[1] > 1 else 1, : x * 2 if size[2] > 1 else 1]
        whole = cut.reshape(z, -1, y, cut.shape[1] // y, x, cut.shape[2] // x).mean((1, 3, 5))


def test_bands_equal_one_blur_of_the_whole(spark, tmp_path):
    r = np.random.default_rng(5)
    cells = [(4, x, y, int(z), int(v), int(u), 3.0) for x, y in ((0, 0), (2, 0), (1, 2)) for z, v, u in r.integers(0, 4, (30, 3))]
    df = spark.createDataFrame(cells, VOXELS).dropDuplicates(["tx", "ty", "vz", "vy", "vx"])
    region, maps = (-179.0, 70.0, -110.0, 84.0), []
    for name, band in (("one", 1 << 20), ("many", 1), ("some", 40)):
        out = sinks.shadow_map_file(df, str(tmp_path / name), f"{name}.ktx2", 4, 4, 4, region, band_pixels=band).collect()
        data = (tmp_path / name / f"{name}.ktx2").read_bytes()
        assert [tuple(x) for x in out] == [(f"{name}.ktx2", len(data))] and os.listdir(tmp_path / name) != []
        assert set(there(str(tmp_path / name))) == {f"{name}.ktx2"}
        head, mips, pairs = ktx2.decode(data)
        maps.append(np.frombuffer(mips[0], "<f2").reshape(head["height"], head["width"]))
        assert head["depth"] == 0 and float(pairs["min_x"]) < float(pairs["max_x"])
    assert (maps[0] == maps[1]).all() and (maps[0] == maps[2]).all() and maps[0].max() > 1 and maps[0].min() == 0
    with pytest.raises(ValueError):
        sinks.shadow_map_file(df, str(tmp_path / "no"), "no", 4, 4, 4, (10.0, 10.0, 10.0, 10.0))


def test_strip_is_a_gaussian():
    r = np.random.default_rng(1)
    data = r.uniform(0, 1, (20, 3))
    taps = stencil.gauss_weights(1.0)
    want = np.zeros((12, 3))
    for y in range(12):
        for x in range(3):
            for dy, a in taps:
                for dx, b in taps:
                    i = (x + dx) % 6
                    want[y, x] += a * b * data[y + 4 + dy, min(i, 5 - i)]
    assert np.allclose(sinks.blurred_strip(data, 1.0), want) and (sinks.blurred_strip(data, 0) == data).all()
