"""Tiles are made and read some at a time: memory doesn't grow with the tiles of a task."""

import numpy as np
import pytest

from stratavox.operators import bc4, components, lod
from stratavox.plans import queries as plans


def test_tiles_come_in_bounded_stacks(spark, monkeypatch):
    """150 sparse tiles of 4 x 4 x 4 in one partition, 10 at once: all are there, each once, with its own values."""
    monkeypatch.setattr(lod, "AT_ONCE", 640)
    rng = np.random.default_rng(5)
    cells = sorted({(3, int(t) % 15, int(t) // 15, *map(int, at)) for t in range(150) for at in rng.integers(0, 4, (5, 3))})
    df = spark.createDataFrame([(*c, float(i + 1)) for i, c in enumerate(cells)], "zoom int, tx int, ty int, vz int, vy int, vx int, density double")

    def run(names, values):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"tx": names[:, 1], "ty": names[:, 2], "n": np.full(len(names), len(names)), "v": list(values.reshape(len(names), -1))})

    got = lod.by_tile(df, 4, 4, run, "tx long, ty long, n long, v array<double>").collect()
    want = {}
    for i, (_, tx, ty, z, y, x) in enumerate(cells):
        want.setdefault((tx, ty), np.zeros(64))[(z * 4 + y) * 4 + x] = i + 1
    assert len(got) == 150 and max(r.n for r in got) == 10
    assert all((want[r.tx, r.ty] == r.v).all() for r in got)


def test_payloads_of_stacks_as_of_planes():
    values = np.random.default_rng(6).uniform(0, 1, (3, 2, 6, 5))
    content = bc4.encode_volumes(values)
    for v, c in zip(values, content, strict=True):
        assert c.tobytes() == b"".join(bc4.encode_plane(p) for p in v)
        assert np.allclose(bc4.decode_volumes(c[None], (2, 6, 5))[0], [bc4.decode_plane(bc4.encode_plane(p), 2)[:6, :5] for p in v])


@pytest.mark.parametrize("name", ["bc4_endpoints", "bc4_decode", "bc4_volume"])
def test_blocks_by_batches(spark, small, name):
    plan = plans.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "0.004" not in plan and "POWER" not in plan  # neither search nor palette row by row


@pytest.mark.parametrize("name", ["raw_tile_roundtrip", "ktx2_roundtrip"])
def test_no_tile_of_collected_cells(spark, small, name):
    assert "collect_list" not in plans.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_slabs_are_small():
    """A task holds two slabs of indices, labels and pairs at most."""
    assert components.SLAB <= 1 << 18


def test_bands_are_made_once(spark, small):
    """The total of a pixel comes from its bands in one pass; a join made the grid and the bands twice."""
    plan = plans.queries()["layer_composite"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("lineitem.parquet") == 1
