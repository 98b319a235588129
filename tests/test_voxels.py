"""The voxel kernels against plain arithmetic, point by point: sampling, physics and noise as a whole."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import kernels, physics, shear
from stratavox.operators import bc4, sample
from stratavox.plans.base import columns as model_columns, wind_columns
from stratavox.plans.q_functions import SCALES
from stratavox.session import ship
from stratavox.sources import ktx2

from .test_functions import pchip

N = 12
FIELDS = ("clc", "qc", "qi", "qv", "t", "p")
STORED = {"qc": 1e4, "qi": 1e4, "qv": 1e4, "p": 1e-3}


def clip(v, low=0.0, high=1.0):
    return min(max(v, low), high)


def ramp(low, high, x):
    t = clip((x - low) / (high - low))
    return t * t * (3 - 2 * t)


def mix(a, b, t):
    return a + t * (b - a)


def octaves(noise, x, y, z, n):
    """Octaves of one of the batch noises, at one point."""
    return float(kernels.fbm(noise, *(np.array([float(v)]) for v in (x, y, z)), n)[0])


def nodes(values, k):
    return [values[min(max(k + i, 0), len(values) - 1)] for i in (-1, 0, 1, 2)]


class Model:
    """Model columns as lists, sampled one point at a time."""

    def __init__(self, rows):
        self.columns = {(r.iy, r.ix): r for r in rows}

    def stencil(self, x, y):
        def weights(f):
            return [(1 - f) ** 3 / 6, 2 / 3 - f * f + f**3 / 2, 2 / 3 - (1 - f) ** 2 + (1 - f) ** 3 / 2, f**3 / 6]

        cx, cy = math.floor(x), math.floor(y)
        for j, wy in enumerate(weights(y - cy)):
            for i, wx in enumerate(weights(x - cx)):
                yield self.columns[min(max(cy + j - 1, 0), N - 1), min(max(cx + i - 1, 0), N - 1)], wx * wy

    def material(self, x, y, h):
        if not (0 <= x <= N - 1 and 0 <= y <= N - 1 and h > 0):
            return dict.fromkeys(FIELDS, 0.0)
        total, sums = 0.0, dict.fromkeys(FIELDS, 0.0)
        for c, w in self.stencil(x, y):
            if not c.hhl[-1] <= h < c.hhl[0]:
                continue
            k = max(sum((a + b) / 2 >= h for a, b in zip(c.hhl, c.hhl[1:], strict=False)) - 1, 0)
            above = nodes(c.hhl, k)
            below = nodes(c.hhl, k + 1)
            z = [(a + b) / 2 for a, b in zip(above, below, strict=True)]
            total += w
            for f in FIELDS:
                sums[f] += w * pchip(z, nodes(c[f], k), h)
        out = {f: v / STORED.get(f, 1.0) / (total if total > 1e-5 else 1.0) for f, v in sums.items()}
        for f in ("qc", "qi", "qv", "t"):
            out[f] = max(out[f], 0.0)
        out["clc"] = clip(out["clc"])
        return out

    def turbulence(self, x, y, h):
        total = value = 0.0
        for c, w in self.stencil(x, y):
            if h < c.hhl[0]:
                k = clip(sum(v >= h for v in c.hhl) - 1, 0, len(c.hhl) - 2)
                total += w
                value += w * pchip(nodes(c.hhl, k), nodes(c.tke, k), max(h, c.hhl[-1]))
        return max(value / total if total > 1e-5 else value, 0.0)

    def ground(self, x, y):
        return sum(w * c.hhl[-1] for c, w in self.stencil(x, y))


def state(m):
    """Cover with condensate that goes with it."""
    m = dict(m, cover=max(m["clc"], clip((m["qc"] + m["qi"]) / 3e-5)))
    if m["cover"] > 0 and m["t"] > 180 and m["p"] > 100:
        ice = clip((273.15 - m["t"]) / 38)
        m["qc"], m["qi"] = max(m["qc"], m["cover"] * 3e-5 * (1 - ice)), max(m["qi"], m["cover"] * 3e-5 * ice)
    return m


def extinct(m, cover, water=1000.0, ice=917.0, limited=True):
    rho = m["p"] / (287.05 * m["t"] * (1 + 0.608 * m["qv"]))
    lwc, iwc = (m[q] / max(cover, 0.001) * rho for q in ("qc", "qi"))
    beta = 0.0
    if lwc > 1e-7:
        beta += 1.5 * lwc / water / clip(100e-6 * (lwc * 1000 * 3 / (4 * math.pi * 200)) ** (1 / 3), 4e-6, 15e-6)
    if iwc > 1e-7:
        t, g = m["t"] - 273.15, iwc * 1000
        if limited:
            t, g = clip(t, -70, -5), clip(g, 1e-4, 0.3)
        size = (45.8966 * g**0.2214 + 0.7957 * g**0.2535 * (t + 190)) * (1.2351 + 0.0105 * t)
        beta += 1.5 * iwc / ice / clip(3 * math.sqrt(3) / 8 * size * 1e-6, 10e-6, 150e-6)
    return beta


def moved(x, y, z, tke):
    sigma = math.sqrt(max(tke * 2 / 3, 0))
    if sigma <= 0.01:
        return 0.0, 0.0, 0.0
    size = clip(sigma / math.sqrt(10 / 3)) * 500
    shifts = ((17.3, 0, 0), (0, 31.7, 0), (0, 0, 53.1))
    return tuple((octaves(kernels.perlin, x / 800 + a, y / 800 + b, z / 800 + c, 2) - 0.5) * size for a, b, c in shifts)


def factor(x, y, z, cover, tke):
    at = lambda noise, xy, v, n: octaves(noise, x / xy, y / xy, z / v, n)
    towers = max(ramp(0.05, 0.5, tke) * (1 - ramp(5000, 8000, z)), ramp(0.8, 1.5, tke))
    slab = (at(kernels.perlin, 3000, 2000, 2) - 0.5) * 0.4 * 4 * cover * (1 - cover)
    lumps = (0.7 * (at(kernels.perlin, 2200, 1500, 3) - 0.5) + 0.4 * (at(kernels.perlin, 800, 400, 3) - 0.5)) * ramp(0, 0.15, cover) * 1.5
    shape = ramp(0, mix(1, 0.5, towers), clip(cover + mix(slab, lumps, towers)))
    texture = at(kernels.perlin, 1500, 2000, 4) * at(kernels.worley, 600, 1300, 3) * at(kernels.worley, 150, 150, 3)
    bumps = max(1 + (texture - 0.125) * 6, 0.3) * (1 - 0.3 * clip(tke * 0.5))
    return shape * mix(0.6 + 0.4 * at(kernels.perlin, 2000, 1000, 2), mix(bumps, 1, ramp(0.2, 0.8, shape)), towers)


@pytest.fixture(scope="module")
def model(spark, small):
    columns = model_columns(spark, small).filter("iy < 12").cache()
    yield columns, Model(columns.collect())
    columns.unpersist()


@pytest.fixture(scope="module")
def points(spark):
    """Places on and off the grid, at its edges, at the ground, in and above the model's columns."""
    rng = np.random.default_rng(11)
    rows = [(float(x), float(y), float(h)) for x, y, h in zip(rng.uniform(0, 11, 60), rng.uniform(0, 11, 60), rng.uniform(5, 11500, 60), strict=True)]
    rows += [(0.0, 0.0, 500.0), (11.0, 11.0, 500.0), (5.5, 5.5, 0.0), (5.5, 5.5, -20.0), (5.5, 5.5, 40.0), (5.5, 5.5, 11050.0), (5.5, 5.5, 20000.0), (-0.5, 3.0, 900.0), (3.0, 11.5, 900.0)]
    rows = [(i, x, y, h, i * 211.0, i * 97.0, 1 / 2000, 1 / 2000) for i, (x, y, h) in enumerate(rows)]
    return spark.createDataFrame(rows, "k int, src_x double, src_y double, height double, world_x double, world_y double, to_src_x double, to_src_y double"), rows


def by_key(df):
    return {r.k: r for r in df.collect()}


def test_material_in_all_fields(points, model):
    got = by_key(sample.sample_material(points[0], model[0], N, N, ["k"]))
    assert len(got) == len(points[1])
    for k, x, y, h, *_ in points[1]:
        want = model[1].material(x, y, h)
        for f in FIELDS:
            assert got[k][f] == pytest.approx(want[f], rel=1e-9, abs=1e-12), (k, f)


def test_plain_voxels(points, model):
    got = by_key(sample.synthesise_plain(points[0], model[0], N, N, ["k"]))
    assert len(got) == len(points[1])
    for k, x, y, h, *_ in points[1]:
        m = state(model[1].material(x, y, h))
        want = 1000 * extinct(m, m["cover"]) * m["cover"] * clip((h - model[1].ground(x, y)) / 200) if m["cover"] > 0 else 0.0
        assert got[k].density == pytest.approx(want, rel=1e-9, abs=1e-12), k
    assert sum(r.density > 0 for r in got.values()) > 20


def test_voxels_with_displacement_and_factor(points, model):
    got = by_key(sample.synthesise(points[0], model[0], N, N, ["k"]))
    assert len(got) == len(points[1])
    for k, x, y, h, wx, wy, tx, ty in points[1]:
        tke = model[1].turbulence(x, y, h)
        dx, dy, dz = moved(wx, wy, h, tke)
        m = state(model[1].material(x + dx * tx, y - dy * ty, h + dz))
        want = 0.0
        if m["cover"] > 0:
            f = clip(factor(wx + dx, wy + dy, h + dz, m["cover"], tke), 0, 2)
            want = 1000 * extinct(m, m["cover"]) * f * clip((h - model[1].ground(x, y)) / 200) if f > 0 else 0.0
        assert got[k].density == pytest.approx(want, rel=1e-7, abs=1e-9), k
    assert sum(r.density > 0 for r in got.values()) > 20


def test_shear_density_and_its_extinction(spark):
    ship(spark)
    rng = np.random.default_rng(12)
    rows = [tuple(map(float, v)) for v in zip(rng.uniform(0, 9000, 40), rng.uniform(0, 9000, 40), rng.uniform(0, 9000, 40), rng.uniform(0, 1, 40), rng.uniform(0, 3, 40), rng.uniform(-1, 3, 40), strict=True)]
    rows += [(100.0, 200.0, 300.0, c, e, w) for c in (0.0, 1.0) for e in (0.0, 6.0) for w in (-1.0, 5.0)]
    state_ = {"qc": 1e-5, "qi": 1e-6, "qv": 1e-3, "t": 260.0, "p": 7e4}
    literals = [F.lit(state_[f]) for f in ("qc", "qi", "qv", "t", "p")]
    df = spark.createDataFrame(rows, "x double, y double, z double, clc double, tke double, w double")
    seen = 0
    for r in df.select("*", physics.shear_density("x", "y", "z", "clc", "tke", "w", SCALES).alias("d"), physics.extinction_shear(*literals, "clc").alias("beta")).collect():
        at = lambda noise, name, n: octaves(noise, r.x / SCALES[name][0], r.y / SCALES[name][0], r.z / SCALES[name][1], n)  # noqa: B023, E731
        size = mix(SCALES["small"][0], SCALES["large"][0], ramp(0, 0.8, r.clc))
        low, high = ("small", "middle") if size < SCALES["middle"][0] else ("middle", "large")
        share = (size - SCALES[low][0]) / (SCALES[high][0] - SCALES[low][0])
        cells = mix(at(kernels.worley_saturating, low, 2), at(kernels.worley_saturating, high, 2), share)
        base = mix(0.5 + 0.5 * at(kernels.perlin, "stratus", 2), cells, ramp(0, 2, r.w))
        bar = 1 - r.clc + (0.35 - at(kernels.worley_saturating, "perturb", 2)) * 0.2 * ramp(0, 0.2, r.clc)
        worn = clip(r.tke * 0.2)
        if worn > 0.01:
            base -= at(kernels.worley_saturating, "detail", 3) * worn
            bar -= worn / 2
        want = clip((base - bar) / max(r.clc, 0.15))
        seen += 0 < want < 1
        assert r.d == pytest.approx(want, abs=1e-9)
        assert r.beta == pytest.approx(extinct(state_, r.clc, 1.0, 1.0, False), rel=1e-12)
    assert seen > 5


def test_shear_kernel_up_whole_columns(spark, small):
    """Sampling, shear, billows, displacement, density and extinction of the older kernel, voxel by voxel."""
    columns = wind_columns(spark, small).filter("iy < 12")
    cols = Model(columns.collect())
    rng = np.random.default_rng(13)
    rows = [(i, float(x), float(y), [float(v) for v in np.linspace(0, 11500, 12) + rng.uniform(0, 300)], i * 311.0, i * -97.0) for i, (x, y) in enumerate(rng.uniform(0, 11, (12, 2)))]
    rows += [(90, 5.5, 5.5, [500.0, 500.2, 900.0], 1.0, 2.0), (91, 3.0, 3.0, [], 1.0, 2.0), (92, -3.0, 14.0, [700.0], 5.0, 6.0)]
    targets = spark.createDataFrame(rows, "k int, src_x double, src_y double, heights array<double>, world_x double, world_y double")
    sampled = {(r.k, r.z): r for r in sample.sample_older(targets, columns, N, N, ["k"]).collect()}
    got = {(r.k, r.z): r.density for r in sample.synthesise_shear(targets, columns, N, N, ["k"]).collect()}
    assert set(got) == set(sampled) == {(r[0], z) for r in rows for z in range(len(r[3]))}
    at = lambda noise, p, xy, v, n: octaves(noise, p[0] / xy, p[1] / xy, p[2] / v, n)
    seen = moved_ = 0
    for k, sx, sy, heights, wx, wy in rows:
        before = None
        for z, h in enumerate(heights):
            f = dict.fromkeys(shear.FIELDS, 0.0)
            for c, weight in cols.stencil(sx, sy):
                if not c.hhl[-1] < h < c.hhl[0]:
                    continue
                n = len(c.hhl) - 2
                while n > 0 and h > (c.hhl[n] + c.hhl[n + 1]) / 2:
                    n -= 1
                mid = [(a + b) / 2 for a, b in zip(nodes(c.hhl, n), nodes(c.hhl, n + 1), strict=True)]
                for name in shear.CELLS:
                    f[name] += weight * pchip(mid, nodes(c[name][: len(c.hhl) - 1], n), h)
                low = n if h >= c.hhl[n + 1] else n + 1
                f["w"] += weight * pchip(nodes(c.hhl, low), nodes(c.w, low), h)
            for name in shear.FIELDS:
                assert sampled[k, z][name] == pytest.approx(f[name], rel=1e-9, abs=1e-12), (k, z, name)
            du = dv = 0.0
            if before:
                dz = max(h - before[0], 1.0)
                du, dv = (f["u"] - before[1]) / dz, (f["v"] - before[2]) / dz
            before = h, f["u"], f["v"]
            want, clc = 0.0, clip(f["clc"])
            if clc > 0:
                m = {q: max(f[q], 0.0) for q in ("qc", "qi", "qv", "t", "tke")} | {"p": f["p"] * 1000}
                p, size = [wx, wy, h], math.hypot(du, dv)
                if size > 1e-4:
                    strength = clip((0.25 - 1 / (1 + m["tke"] * size * 100)) / 0.25)
                    length = 7.07 * clip(math.sqrt(2 * m["tke"]) / size, 50, 500)
                    angle, reach = 2 * math.pi * (wx * du + wy * dv) / size / length, strength * 0.3 * length
                    p = [wx + math.sin(angle) * reach * du / size, wy + math.sin(angle) * reach * dv / size, h + math.cos(angle) * reach]
                    moved_ += reach > 0
                sigma = math.sqrt(m["tke"] * 2 / 3)
                if sigma > 0.01:
                    far = clip(sigma / math.sqrt(10 / 3)) * 150
                    q = [v / 600 for v in p]
                    p[0] += (octaves(kernels.perlin, q[0] + 17.3, q[1], q[2], 2) - 0.5) * far
                    p[1] += (octaves(kernels.perlin, q[0], q[1] + 31.7, q[2], 2) - 0.5) * far
                width = mix(600, 3200, ramp(0, 0.8, clc))
                pair = ((600, 400), (1400, 1400)) if width < 1400 else ((1400, 1400), (3200, 4000))
                cells = mix(*[at(kernels.worley_saturating, p, *s, 2) for s in pair], (width - pair[0][0]) / (pair[1][0] - pair[0][0]))
                shape = mix(0.5 + 0.5 * at(kernels.perlin, p, 2000, 1000, 2), cells, ramp(0, 2, f["w"]))
                bar = 1 - clc + (0.35 - at(kernels.worley_saturating, p, 3000, 2000, 2)) * 0.2 * ramp(0, 0.2, clc)
                worn = clip(m["tke"] * 0.2)
                if worn > 0.01:
                    shape, bar = shape - worn * at(kernels.worley_saturating, p, 400, 300, 3), bar - worn / 2
                share = clip((shape - bar) / max(clc, 0.15))
                want = share * extinct(m, clc, 1.0, 1.0, False) if share > 0 else 0.0
            seen += want > 0
            assert got[k, z] == pytest.approx(want, rel=1e-7, abs=1e-9), (k, z)
    assert seen > 20 and moved_ > 20
    assert sample.synthesise_shear(targets.limit(0), columns, N, N, ["k"]).count() == 0


def test_blocks_of_odd_sides_repeat_the_edge(spark):
    """Sides of 5 and 6 are filled up to 8 with the last row and column."""
    canvas = np.arange(30).reshape(5, 6) / 30
    df = spark.createDataFrame([(0, y, x, float(canvas[y, x])) for y in range(5) for x in range(6)], "vz int, vy int, vx int, density double")
    want = np.pad(canvas, ((0, 3), (0, 2)), mode="edge")
    got = bc4.blocks(df, 5, 6, ["vz"]).collect()
    assert sorted((r.by, r.bx) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for r in got:
        assert r.pixels == want[r.by * 4 : r.by * 4 + 4, r.bx * 4 : r.bx * 4 + 4].ravel().tolist()


@pytest.mark.parametrize("name", sorted(ktx2.FORMATS))
def test_descriptor_is_laid_out_as_the_format_demands(name):
    """Khronos data format descriptor: sizes, colour model and samples at their places."""
    f, d = ktx2.FORMATS[name], ktx2._descriptor(name)
    total, vendor, version, size = struct.unpack_from("<IIHH", d)
    samples = 1 if f["block"] else f["channels"]
    assert total == len(d) == 28 + 16 * samples and vendor == 0 and version == 2 and size == total - 4
    model_, primaries, transfer, flags = d[12:16]
    assert (primaries, transfer, flags) == (1, 1, 0) and model_ == f.get("model", 1)
    assert d[16:20] == (bytes([3, 3, 0, 0]) if f["block"] else bytes(4))
    bits = f["block"] * 8 if f["block"] else np.dtype(f["kind"]).itemsize * 8
    assert d[20] == (f["block"] or f["channels"] * bits // 8)
    for i in range(samples):
        offset, length = struct.unpack_from("<HB", d, 28 + 16 * i)
        assert offset == i * bits and length == bits - 1
        low, high = struct.unpack_from("<II", d, 28 + 16 * i + 8)
        if f["block"]:
            assert (low, high) == (0, 0xFFFFFFFF)
        elif f["kind"][0] == "f":
            assert struct.unpack_from("<ff", d, 28 + 16 * i + 8) == (-1.0, 1.0)
