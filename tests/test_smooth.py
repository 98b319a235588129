"""Smoothing by 27 neighbours: slab by slab as by windows, and no row for each neighbour."""

import numpy as np
import pytest

from stratavox.operators import stencil
from stratavox.plans import queries as plans


@pytest.mark.parametrize("slab", [1, 40, 1 << 19])
def test_slabs_as_windows(spark, monkeypatch, slab):
    monkeypatch.setattr(stencil, "SLAB", slab)
    values = np.random.default_rng(3).integers(0, 64, (2, 7, 3, 5)).astype(float)
    df = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(values) for at in [at]], "k int, vz int, vy int, vx int, density double")
    rows = lambda d: sorted((r.k, r.vz, r.vy, r.vx, r.density) for r in d.collect())
    assert rows(stencil.smooth_direct(df, 7, 3, 5, keys=("k",))) == rows(stencil.smooth(df, keys=("k",)))
    one = df.filter("k = 1").drop("k")
    assert sorted(map(tuple, stencil.smooth_direct(one, 7, 3, 5).collect())) == sorted(map(tuple, stencil.smooth(one).select("vz", "vy", "vx", "density").collect()))


def test_voxels_are_not_sent_to_every_neighbour(spark, small):
    plan = plans.queries()["smooth_27"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroupsInArrow" in plan  # the one join makes the grid
