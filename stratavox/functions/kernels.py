"""The noise kernels on whole Arrow batches.

The native columns of `noise` and `physics` evaluate lambdas row by row, which is fine for a single
noise but not for a density factor of a hundred lattice hashes a voxel. These do the same arithmetic,
in double precision, in numpy over a batch; tests hold both against each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .noise import GRADIENTS, PRIMES
from .physics import L_MIX, MAX_DISPLACEMENT

_P = [np.uint32(p) for p in PRIMES]
_G = np.array(GRADIENTS, np.float64)


def _hash(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = x * _P[0] ^ y * _P[1] ^ z * _P[2]
    h = (h ^ (h >> np.uint32(16))) * _P[1]
    h = (h ^ (h >> np.uint32(13))) * _P[2]
    return h ^ (h >> np.uint32(16))


def _cells(*axes: np.ndarray):
    """Lattice cells as unsigned 32-bit values that keep the sign bits, and fractions."""
    floors = [np.floor(a) for a in axes]
    return [f.astype(np.int64).astype(np.uint32) for f in floors], [a - f for a, f in zip(axes, floors, strict=True)]


def perlin(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    (i, j, k), f = _cells(x, y, z)
    fade = [t * t * t * (t * (t * 6.0 - 15.0) + 10.0) for t in f]
    total = np.zeros(len(x))
    for corner in range(8):
        d = (corner & 1, corner >> 1 & 1, corner >> 2)
        h = _hash(i + np.uint32(d[0]), j + np.uint32(d[1]), k + np.uint32(d[2])) & np.uint32(15)
        share = math.prod((fade[a] if d[a] else 1.0 - fade[a]) for a in range(3))
        total += share * sum(_G[h, a] * (f[a] - d[a]) for a in range(3))
    return 0.5 + 0.5 * total


def nearest_squared(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    (i, j, k), f = _cells(x, y, z)
    zero, low = np.zeros(len(x), np.uint32), np.uint32(65535)
    best = np.full(len(x), np.inf)
    for n in range(27):
        d = (n % 3 - 1, n // 3 % 3 - 1, n // 9 - 1)
        hashes = [_hash(i + np.uint32(d[0] & 0xFFFFFFFF), j + np.uint32(d[1] & 0xFFFFFFFF), k + np.uint32(d[2] & 0xFFFFFFFF))]
        hashes.append(_hash(hashes[0], zero, zero))
        hashes.append(_hash(hashes[1], zero, zero))
        np.minimum(best, sum((d[a] + (hashes[a] & low) / 65535.0 - f[a]) ** 2 for a in range(3)), out=best)
    return best


def worley(x, y, z) -> np.ndarray:
    return 1.0 - np.sqrt(nearest_squared(x, y, z))


def worley_squared(x, y, z) -> np.ndarray:
    return 1.0 - nearest_squared(x, y, z)


def worley_saturating(x, y, z) -> np.ndarray:
    held = [np.maximum(np.floor(a), 0.0) + (a - np.floor(a)) for a in (x, y, z)]
    return 1.0 - np.sqrt(np.minimum(nearest_squared(*held), 1.0))


def fbm(noise, x, y, z, octaves: int) -> np.ndarray:
    return 0.5 + sum((noise(x * 2.0**i, y * 2.0**i, z * 2.0**i) - 0.5) * 0.5 ** (i + 1) for i in range(octaves))


def smoothstep(low, high, x) -> np.ndarray:
    t = np.clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def arrays(*series: pd.Series) -> list[np.ndarray]:
    return [s.to_numpy(np.float64, na_value=np.nan) for s in series]


def _factor(x, y, z, clc, tke) -> np.ndarray:
    at = lambda noise, xy, vertical, octaves: fbm(noise, x / xy, y / xy, z / vertical, octaves)
    towers = np.maximum(smoothstep(0.05, 0.5, tke) * (1.0 - smoothstep(5000.0, 8000.0, z)), smoothstep(0.8, 1.5, tke))
    slab = (at(perlin, 3000.0, 2000.0, 2) - 0.5) * 1.6 * clc * (1.0 - clc)
    lumps = (0.7 * (at(perlin, 2200.0, 1500.0, 3) - 0.5) + 0.4 * (at(perlin, 800.0, 400.0, 3) - 0.5)) * 1.5 * smoothstep(0.0, 0.15, clc)
    shape = smoothstep(0.0, 1.0 - 0.5 * towers, np.clip(clc + slab + towers * (lumps - slab), 0.0, 1.0))
    texture = at(perlin, 1500.0, 2000.0, 4) * at(worley, 600.0, 1300.0, 3) * at(worley, 150.0, 150.0, 3)
    bumps = np.maximum(6.0 * texture + 0.25, 0.3) * (1.0 - 0.3 * np.clip(0.5 * tke, 0.0, 1.0))
    core = smoothstep(0.2, 0.8, shape)
    calm = 0.4 * at(perlin, 2000.0, 1000.0, 2) + 0.6
    return shape * (calm + towers * (bumps + core * (1.0 - bumps) - calm))


def density_factor(x, y, z, clc, tke) -> Column:
    """As physics.density_factor, by batches; NaN where an input is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series, clc: pd.Series, tke: pd.Series) -> pd.Series:
        return pd.Series(_factor(*arrays(x, y, z, clc, tke)))

    return run(*map(col, (x, y, z, clc, tke)))


def displacement(x, y, z, tke) -> Column:
    """As physics.displacement, by batches."""

    @F.pandas_udf("dx double, dy double, dz double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series, tke: pd.Series) -> pd.DataFrame:
        x, y, z, tke = arrays(x, y, z, tke)
        sigma = np.sqrt(np.maximum(tke * 2.0 / 3.0, 0.0))
        size = np.where(sigma <= 0.01, 0.0, np.clip(sigma / math.sqrt(10.0 / 3.0), 0.0, 1.0) * MAX_DISPLACEMENT)
        p = [v / L_MIX for v in (x, y, z)]
        moved = {}
        for name, axis, offset in (("dx", 0, 17.3), ("dy", 1, 31.7), ("dz", 2, 53.1)):
            shifted = [v + offset if a == axis else v for a, v in enumerate(p)]
            moved[name] = (fbm(perlin, *shifted, 2) - 0.5) * size
        return pd.DataFrame(moved)

    return run(*map(col, (x, y, z, tke)))


def noise_value(kind: str, x, y, z, octaves: int) -> Column:
    """Octaves of a noise of NOISES, by batches; the noise itself where `octaves` is 0."""
    make = NOISES[kind]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        at = arrays(x, y, z)
        return pd.Series(fbm(make, *at, octaves) if octaves else make(*at))

    return run(*map(col, (x, y, z)))


NOISES = {"perlin": perlin, "worley": worley, "worley_squared": worley_squared, "worley_saturating": worley_saturating}
