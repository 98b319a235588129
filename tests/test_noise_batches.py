"""Noise queries run by batches, and batches agree with native columns."""

import pytest
from pyspark.sql import functions as F

from stratavox.functions import kernels, noise, physics, shear
from stratavox.plans import queries as plans
from stratavox.plans.q_functions import SCALES
from stratavox.session import ship

POINTS = [(0.0, 0.0, 0.0), (-7.3, 2.25, 40.5), (3.99, -5.01, 0.5), (812.7, -44.2, 1e6), (-1e-9, 1.0, -3.0)]


@pytest.mark.parametrize("name", ["worley", "worley_saturating", "fbm_worley", "fbm_worley_biased", "fbm_gradient", "density_factor_native", "shear_density"])
def test_noise_by_batches(spark, small, name):
    df = plans.queries()[name](spark, small)
    assert df.rdd.getNumPartitions() >= 4  # the file of parts is one task
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and str(noise.PRIMES[1]) not in plan  # no lattice hash row by row


def test_every_noise_as_native(spark):
    ship(spark)
    df = spark.createDataFrame(POINTS, "x double, y double, z double")
    for kind in kernels.NOISES:
        native = getattr(noise, kind)
        for r in df.select(kernels.noise_value(kind, "x", "y", "z", 0).alias("a"), native("x", "y", "z").alias("b"), kernels.noise_value(kind, "x", "y", "z", 2).alias("c"), noise.fbm(native, "x", "y", "z", 2).alias("d")).collect():
            assert r.a == pytest.approx(r.b, abs=1e-12) and r.c == pytest.approx(r.d, abs=1e-12), kind


def test_densities_as_native(spark):
    ship(spark)
    at = ("x", "y", "z", "clc", "tke")
    df = spark.createDataFrame([(*p, c, e, w) for p in POINTS[:3] for c in (0.0, 0.3, 1.0) for e, w in ((0.0, -1.0), (0.9, 1.0), (6.0, 3.0))], "x double, y double, z double, clc double, tke double, w double")
    for r in df.select(kernels.density_factor(*at).alias("a"), physics.density_factor(*at).alias("b"), shear.shear_density(*at, "w", SCALES).alias("c"), physics.shear_density(*at, "w", SCALES).alias("d")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-12) and r.c == pytest.approx(r.d, abs=1e-12)
