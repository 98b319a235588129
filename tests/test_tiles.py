"""Sampling by tiles of model columns: places at the borders of tiles and beyond the grid, and plans without joins."""

import math

import pytest

from stratavox.operators import sample
from stratavox.plans import queries as plans

NX, NY = 70, 140


@pytest.fixture(scope="module")
def columns(spark):
    rows = [(y, x, [5000.0 + y + x * x, 2000.0 + x, 10.0 * y + 3.0 * x], [0.1 * x, 0.2 * y, 0.5]) for y in range(NY) for x in range(NX) if (y, x) != (64, 64)]
    return spark.createDataFrame(rows, "iy int, ix int, hhl array<double>, tke array<double>"), {(y, x): h[-1] for y, x, h, _ in rows}


def _weights(f):
    return [(1 - f) ** 3 / 6, 2 / 3 - f * f + f**3 / 2, 2 / 3 - (1 - f) ** 2 + (1 - f) ** 3 / 2, f**3 / 6]


def test_ground_across_tiles(spark, columns):
    """Points near borders of tiles, off the grid, far off, and without a place; many meet in one tile."""
    at = [0.0, 0.5, 61.9, 62.0, 63.2, 64.0, 64.9, 65.5, 69.0, 127.5, 128.3, 139.0]
    places = [(x, y) for x in [*at[:9], -1.5, -900.0, 70.5, 1e12] for y in [*at, -3.2, 141.9, -1e12]] + [(64.0 + i % 97 / 300, 63.5) for i in range(3000)] + [(None, 3.0)]
    points = spark.createDataFrame([(i, x, y, 100.0) for i, (x, y) in enumerate(places)], "k int, src_x double, src_y double, height double").repartition(5)
    got = {r.k: r.ground for r in sample.ground_height(points, columns[0], NX, NY, ["k"]).collect()}
    assert len(got) == len(places) - 1
    for k, (x, y) in enumerate(places[:-1]):
        want = 0.0
        for j, wy in enumerate(_weights(y - math.floor(y))):
            for i, wx in enumerate(_weights(x - math.floor(x))):
                here = min(max(math.floor(y) + j - 1, 0), NY - 1), min(max(math.floor(x) + i - 1, 0), NX - 1)
                want += wy * wx * columns[1].get(here, 0.0)
        assert got[k] == pytest.approx(want, rel=1e-9), (x, y)


@pytest.mark.parametrize("name", ["sample_turbulence", "ground_height", "synthesise_plain", "synthesise", "sample_older", "synthesise_shear", "sample_material"])
def test_no_join_that_could_be_broadcast(spark, small, name):
    """Spark guessed the columns far too small and sent them whole to the driver and all executors."""
    plan = plans.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
