"""Components of grids by slabs against a flood fill."""

import random

import numpy as np
import pytest

from stratavox.operators import components


def flooded(cells, nx, ny):
    there, out = set(cells), {}
    index = lambda c: (c[0] * ny + c[1]) * nx + c[2]
    for start in sorted(there, key=index):
        if start in out:
            continue
        queue = [start]
        out[start] = index(start)
        while queue:
            z, y, x = queue.pop()
            for c in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                if c in there and c not in out and 0 <= c[1] < ny and 0 <= c[2] < nx:
                    out[c] = index(start)
                    queue.append(c)
    return {index(c): r for c, r in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_labels_of_one_slab(seed):
    r = random.Random(seed)
    nx, ny = r.randrange(1, 7), r.randrange(1, 7)
    cells = [(z, y, x) for z in range(9) for y in range(ny) for x in range(nx) if r.random() < 0.45]
    want = flooded(cells, nx, ny)
    index = np.array(sorted(want))
    assert components.labels(index, nx, ny).tolist() == [want[i] for i in index.tolist()]


def test_a_snake_takes_few_passes():
    nx, ny = 201, 201
    cells = [(0, y, x) for y in range(ny) for x in range(nx) if y % 2 == 0 or x == (nx - 1 if y % 4 == 1 else 0)]
    index = np.array(sorted(y * nx + x for _, y, x in cells))
    assert set(components.labels(index, nx, ny).tolist()) == {0}


@pytest.mark.parametrize("slab", [1, 40, 1 << 20])
def test_slabs_and_faces(spark, slab):
    r = random.Random(7)
    cells = [(z, y, x) for z in range(40) for y in range(5) for x in range(6) if r.random() < 0.4] + [(z, 4, 5) for z in range(60, 90)] + [(-2, 0, 0), (-1, 0, 0)]
    df = spark.createDataFrame(cells + cells[:50], "z long, y long, x long").repartition(6)
    got = {x["index"]: x.root for x in components.grid_components(df, 6, 5, slab).collect()}
    assert got == flooded(cells, 6, 5)
    assert components.grid_components(spark.createDataFrame([], "z long, y long, x long"), 6, 5).count() == 0
