"""Golden values and properties of the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import geo, half, interp, noise, physics, text
from stratavox.operators import bc4, stats, stencil, volume


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_bspline_weights_sum_to_one(spark):
    w = interp.bspline_weights(F.col("t"))
    got = spark.range(11).select((F.col("id") / 10).alias("t")).select(sum(w[1:], w[0]).alias("s"), F.least(*w).alias("least")).collect()
    assert all(abs(r.s - 1) < 1e-12 and r.least >= 0 for r in got)


def pchip(z, v, at):
    """Fritsch-Carlson by numpy, for comparison."""
    h = [z[i] - z[i + 1] for i in range(3)]
    if abs(h[1]) < 1e-3:
        return v[1]
    s = [(v[i] - v[i + 1]) / h[i] if i == 1 or h[i] > 1e-3 else 0.0 for i in range(3)]

    def tangent(a, b, p, q):
        return 0.0 if p * q <= 0 else (3 * a + 3 * b) / ((2 * b + a) / p + (b + 2 * a) / q)

    m = np.array([tangent(h[0], h[1], s[0], s[1]), tangent(h[1], h[2], s[1], s[2])])
    if abs(s[1]) > 1e-10 and ((m / s[1]) ** 2).sum() > 9:
        m = 3 * m / math.sqrt(((m / s[1]) ** 2).sum())
    t = (z[1] - at) / h[1]
    return (2 * t**3 - 3 * t**2 + 1) * v[1] - (t**3 - 2 * t**2 + t) * h[1] * m[0] + (3 * t**2 - 2 * t**3) * v[2] - (t**3 - t**2) * h[1] * m[1]


def test_pchip_matches_and_stays_within_its_nodes(spark):
    rng = np.random.default_rng(1)
    cases = []
    for _ in range(200):
        z = np.sort(rng.uniform(0, 1000, 4))[::-1]
        v = rng.uniform(-5, 5, 4)
        cases.append((*map(float, z), *map(float, v), float(rng.uniform(z[2], z[1]))))
    cases.append((5.0, 3.0, 3.0, 1.0, 1.0, 2.0, 3.0, 4.0, 3.0))
    names = ["z0", "z1", "z2", "z3", "v0", "v1", "v2", "v3", "at"]
    df = spark.createDataFrame(cases, ", ".join(f"{n} double" for n in names))
    for r in df.select("*", interp.pchip(names[:4], names[4:8], "at").alias("p")).collect():
        assert r.p == pytest.approx(pchip(r[:4], r[4:8], r.at), abs=1e-9)
        assert min(r.v1, r.v2) - 1e-9 <= r.p <= max(r.v1, r.v2) + 1e-9


def test_hash_matches_masked_products(spark):
    def h(x, y, z):
        m = 0xFFFFFFFF
        v = ((x & m) * 0x9E3779B9 ^ (y & m) * 0x85EBCA6B ^ (z & m) * 0xC2B2AE35) & m
        v = ((v ^ v >> 16) * 0x85EBCA6B) & m
        v = ((v ^ v >> 13) * 0xC2B2AE35) & m
        return v ^ v >> 16

    cases = [(0, 0, 0), (1, 2, 3), (-1, -7, 4), (123456789, -987654321, 2**31 - 1)]
    got = spark.createDataFrame(cases, "x long, y long, z long").select("*", noise.hash3("x", "y", "z").alias("h")).collect()
    assert all(r.h == h(r.x, r.y, r.z) for r in got)


def test_round_half_matches_numpy(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 1e-9, 2.0**-24, 3 * 2.0**-25, 65504.0, 65519.9, 65520.0, -70000.0, *map(float, rng.normal(0, 300, 200))]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", half.round_half("x").alias("h")).collect()
    for r in got:
        with np.errstate(over="ignore"):
            assert r.h == float(np.float16(r.x)), r.x


def test_tms_is_its_own_inverse_and_edges_round_trip(spark):
    assert one(spark, geo.flip_row(geo.flip_row(F.lit(300), 10), 10)) == 300
    assert one(spark, geo.tile_lat(geo.tile_y(F.lit(48.0), 10), 10)) == pytest.approx(48.0, abs=1e-9)
    assert one(spark, geo.merc_lat(geo.merc_y(F.lit(-61.5)))) == pytest.approx(-61.5, abs=1e-9)


def test_extinction_golden(spark):
    """Liquid only, full cover: hand-computed from the published formulas."""
    rho = 80000 / (287.05 * 280 * (1 + 0.608 * 0.005))
    lwc = 2e-4 * rho
    r = min(max(100 * (lwc * 1000 * 3 / (4 * math.pi * 200)) ** (1 / 3) * 1e-6, 4e-6), 15e-6)
    want = 1.5 * lwc / (1000 * r) * 1000
    got = one(spark, physics.extinction(F.lit(2e-4), F.lit(0.0), F.lit(0.005), F.lit(280.0), F.lit(80000.0), F.lit(1.0)))
    assert got == pytest.approx(want, rel=1e-12)


def test_text(spark):
    assert one(spark, text.run_time(F.lit("not a run"))) is None
    assert one(spark, text.folder(F.lit("1995061300"), F.lit(7))) == "1995061300_007"
    assert one(spark, text.progress_parts(F.lit(" PROGRESS::lod::a::b::5 "))) is None
    assert one(spark, text.progress_parts(F.lit("PROGRESS::lod::a::5")))["percent"] == 5.0
    assert one(spark, text.timing_map(F.lit("Run completed in 1.00s\nRun completed in 2.00s"))) == {"run": 2.0}
    assert one(spark, text.badge_version(F.lit("https://img.shields.io/badge/version-1.2-blue"))) == "1.2"
    assert one(spark, text.overall_percent(F.lit("shadows"), F.lit(49.999999))) == 95


def test_bc4_round_trip_stays_within_a_step(spark):
    rng = np.random.default_rng(3)
    blocks = [[float(v) for v in rng.uniform(0, 1, 16)], [0.0] * 16, [0.0005] + [0.0] * 15, [1.0] * 16]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, pixels array<double>").withColumn("e", bc4.encode("pixels"))
    df = df.withColumn("b", bc4.from_bytes(bc4.block_bytes("e"))).withColumn("d", bc4.decode("b.r0", "b.r1", "b.bits")).orderBy("i")
    got = df.collect()
    assert all(len(r.d) == 16 for r in got) and got[0].b["bits"] == got[0].e["bits"]
    assert max(abs(a - b) for a, b in zip(got[0].pixels, got[0].d, strict=True)) < 0.08
    assert set(got[1].d) == {0.0}
    assert got[2].d[0] > 0  # what isn't zero doesn't become zero
    assert all(v == pytest.approx(1.0, abs=1 / 255) for v in got[3].d)


def test_pooling_keeps_the_sum(spark):
    rng = np.random.default_rng(4)
    rows = {(10, int(a), int(b), int(c), int(d), int(e)): float(v) for a, b, c, d, e, v in zip(*(rng.integers(0, n, 60) for n in (4, 4, 3, 8, 8)), rng.uniform(0, 9, 60), strict=True)}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "zoom int, tx int, ty int, vz int, vy int, vx int, density double")
    assert volume.pool_mean(df, 8).agg(F.sum("density")).first()[0] * 4 == pytest.approx(sum(rows.values()))
    assert volume.pool_min(df, 8).agg(F.min("density")).first()[0] >= 0


def test_gauss_weights_and_reflection(spark):
    assert sum(w for _, w in stencil.gauss_weights()) == pytest.approx(1)
    got = spark.range(10).select(interp.reflect_index(F.col("id") - 3, F.lit(4)).alias("i")).collect()
    assert [r.i for r in got] == [2, 1, 0, 0, 1, 2, 3, 3, 2, 1]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "zoom int, tx int, ty int, vz int, vy int, vx int, density double")
    for out in (volume.pool_mean(empty), volume.shadow_map(empty, 8), volume.column_sum(empty, 0, 4), volume.pyramid(empty, 8, 10)):
        assert out.count() == 0


def test_kernels_agree_with_native_columns(spark):
    from stratavox.functions import kernels
    from stratavox.session import ship

    ship(spark)
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, (*rng.uniform(-9000, 9000, 2), rng.uniform(0, 12000), rng.uniform(0, 1), rng.uniform(0, 3)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, z double, clc double, tke double")
    a, b = physics.displacement("x", "y", "z", "tke"), kernels.displacement("x", "y", "z", "tke")
    got = df.select(physics.density_factor("x", "y", "z", "clc", "tke").alias("f"), kernels.density_factor("x", "y", "z", "clc", "tke").alias("g"), a.alias("d"), b.alias("e"), noise.fbm(noise.worley_saturating, F.col("x") / 900, F.col("y") / 900, F.col("z") / 900, 2).alias("n"), kernels.noise_value("worley_saturating", F.col("x") / 900, F.col("y") / 900, F.col("z") / 900, 2).alias("m"))
    for r in got.collect():
        assert r.f == pytest.approx(r.g, abs=1e-9) and r.n == pytest.approx(r.m, abs=1e-9)
        assert [r.d[k] for k in ("dx", "dy", "dz")] == pytest.approx([r.e[k] for k in ("dx", "dy", "dz")], abs=1e-6)


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "none"])
def test_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(6)
    values = {"spread": rng.lognormal(0, 4, 3001), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([2.5]), "none": np.array([])}[kind]
    points = {"p0": 0.0, "p3": 0.3, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "x double").repartition(7)
    r = stats.quantiles(df, "x", points).collect()
    assert len(r) == 1 and r[0].n == len(values)
    for name, q in points.items():
        assert r[0][name] == (pytest.approx(float(np.quantile(values, q)), rel=1e-12) if len(values) else None)
    assert r[0].most == (values.max() if len(values) else None)


def test_bc4_kernels_equal_the_columns(spark):
    rng = np.random.default_rng(11)
    sparse = np.where(rng.random((60, 16)) < 0.8, 0.0, rng.random((60, 16)) * 0.01)
    pixels = np.concatenate([rng.random((60, 16)), sparse, np.zeros((1, 16)), np.ones((1, 16)), np.full((1, 16), 0.5), np.eye(16) * 1e-6])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pixels)], "i int, pixels array<double>").withColumn("e", bc4.encode("pixels"))
    rows = df.select("i", bc4.block_bytes("e").alias("b"), bc4.decode("e.r0", "e.r1", "e.bits").alias("v")).orderBy("i").collect()
    content = bc4.encode_blocks(pixels)
    assert [bytes(r.b) for r in rows] == [x.tobytes() for x in content]
    assert np.allclose(bc4.decode_blocks(content), [r.v for r in rows], atol=1e-15)
    six = spark.createDataFrame([(3, 200, int("76543210" * 2, 8))], "r0 int, r1 int, bits long").select(bc4.decode("r0", "r1", "bits").alias("v")).first().v
    raw = np.frombuffer(bytes([3, 200]) + int("76543210" * 2, 8).to_bytes(6, "little"), np.uint8)
    assert np.allclose(bc4.decode_blocks(raw[None]), [six], atol=1e-15)
    plane = rng.random((7, 10))
    assert np.abs(bc4.decode_plane(bc4.encode_plane(plane), 3)[:7, :10] - plane).max() < 0.1
