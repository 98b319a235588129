"""The older voxel kernel on whole columns of air: sampling without make-up weights, wind shear, billows and density.

Works on batches of target columns, whose samples lie one column after the other (see `levels`), so
what the kernel carries up a column is a difference along an array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .kernels import arrays, fbm, perlin, smoothstep, worley_saturating
from .physics import DROPLETS, R_DRY

#: Fields at cell centres, the order of the sampled rows.
CELLS = ("clc", "qc", "qi", "qv", "t", "p", "u", "v", "tke")
FIELDS = (*CELLS, "w")
#: How readily shear overturns, mixing length and largest displacement (m).
SENSITIVITY, MIX, DISPLACEMENT = 100.0, 600.0, 150.0
#: Lengths of the noise in metres, horizontal and vertical.
SCALES = {"stratus": (2000.0, 1000.0), "small": (600.0, 400.0), "middle": (1400.0, 1400.0), "large": (3200.0, 4000.0), "detail": (400.0, 300.0), "perturb": (3000.0, 2000.0)}


def _tangent(h0, h1, s0, s1) -> np.ndarray:
    with np.errstate(all="ignore"):
        a, b = h0 + 2.0 * h1, 2.0 * h0 + h1
        return np.where(s0 * s1 > 0.0, (a + b) / (a / s0 + b / s1), 0.0)


def pchip(z: np.ndarray, v: np.ndarray, at: np.ndarray, guard: bool = False) -> np.ndarray:
    """Monotone cubic between the second and third of four nodes on the last axis, heights falling; an inner interval without width gives its upper value only with `guard`."""
    with np.errstate(all="ignore"):
        h = z[..., :-1] - z[..., 1:]
        s = (v[..., :-1] - v[..., 1:]) / h
        s = np.where((h > 1e-3) | (np.arange(3) == 1), s, 0.0)
        up, down = _tangent(h[..., 0], h[..., 1], s[..., 0], s[..., 1]), _tangent(h[..., 1], h[..., 2], s[..., 1], s[..., 2])
        inner = np.abs(s[..., 1])
        steep = np.hypot(up, down)
        limit = np.where((inner > 1e-10) & (steep > 3.0 * inner), 3.0 * inner / steep, 1.0)
        t = (z[..., 1] - at) / h[..., 1]
        u = 1.0 - t
        value = u * u * (1.0 + 2.0 * t) * v[..., 1] + t * t * (3.0 - 2.0 * t) * v[..., 2] - h[..., 1] * limit * (t * u * u * up - t * t * u * down)
        return np.where(np.abs(h[..., 1]) < 1e-3, v[..., 1], value) if guard else value


def shear(heights: np.ndarray, u: np.ndarray, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """du/dz and dv/dz from the sample below, over a metre at least; 0 at the first of each column."""
    dz = np.maximum(np.diff(heights, prepend=heights[:1]), 1.0)
    return tuple(np.where(first, 0.0, np.diff(a, prepend=a[:1]) / dz) for a in (u, v))


def billowed(x, y, z, du, dv, tke) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points moved by billows where the shear is above 1e-4 a second."""
    size = np.hypot(du, dv)
    with np.errstate(all="ignore"):
        nx, ny = du / size, dv / size
        strength = np.clip((0.25 - 1.0 / (1.0 + tke * size * SENSITIVITY)) / 0.25, 0.0, 1.0)
        length = 7.07 * np.clip(np.sqrt(2.0 * tke) / size, 50.0, 500.0)
        phase = 2.0 * math.pi * (x * nx + y * ny) / length
        most = strength * 0.30 * length
        sheared = size > 1e-4
        return np.where(sheared, x + np.sin(phase) * most * nx, x), np.where(sheared, y + np.sin(phase) * most * ny, y), np.where(sheared, z + np.cos(phase) * most, z)


def stirred(x, y, z, tke) -> tuple[np.ndarray, np.ndarray]:
    """Turbulent displacement, across only."""
    sigma = np.sqrt(2.0 / 3.0 * tke)
    size = np.where(sigma > 0.01, np.clip(sigma / math.sqrt(10.0 / 3.0), 0.0, 1.0) * DISPLACEMENT, 0.0)
    p = [a / MIX for a in (x, y, z)]
    return x + (fbm(perlin, p[0] + 17.3, p[1], p[2], 2) - 0.5) * size, y + (fbm(perlin, p[0], p[1] + 31.7, p[2], 2) - 0.5) * size


def density(x, y, z, clc, tke, w, scales: dict = SCALES) -> np.ndarray:
    """As physics.shear_density, on arrays."""
    noise = lambda kind, name, n: fbm(kind, x / scales[name][0], y / scales[name][0], z / scales[name][1], n)
    small, middle, large = (scales[name][0] for name in ("small", "middle", "large"))
    target = small + (large - small) * smoothstep(0.0, 0.8, clc)
    cells = [noise(worley_saturating, name, 2) for name in ("small", "middle", "large")]
    cumulus = np.where(target < middle, cells[0] + (cells[1] - cells[0]) * (target - small) / (middle - small), cells[1] + (cells[2] - cells[1]) * (target - middle) / (large - middle))
    slab = 0.5 + 0.5 * noise(perlin, "stratus", 2)
    erosion = np.clip(0.2 * tke, 0.0, 1.0)
    worn = np.where(erosion > 0.01, erosion, 0.0)
    shape = slab + (cumulus - slab) * smoothstep(0.0, 2.0, w) - worn * noise(worley_saturating, "detail", 3)
    threshold = 1.0 - clc - 0.5 * worn + (0.35 - noise(worley_saturating, "perturb", 2)) * 0.2 * smoothstep(0.0, 0.2, clc)
    return np.clip((shape - threshold) / np.maximum(clc, 0.15), 0.0, 1.0)


def extinction(qc, qi, qv, t, p, clc) -> np.ndarray:
    """As physics.extinction_shear, on arrays."""
    with np.errstate(all="ignore"):
        rho = p / (R_DRY * t * (1.0 + 0.608 * qv)) / np.maximum(clc, 0.001)
        lwc, iwc = qc * rho, qi * rho
        drop = 1e-4 * np.cbrt(3000.0 * lwc / (4.0 * math.pi * DROPLETS))
        g, celsius = 1000.0 * iwc, t - 273.15
        crystal = 3.0 * math.sqrt(3.0) / 8.0 * 1e-6 * (45.8966 * g**0.2214 + 0.7957 * g**0.2535 * (celsius + 190.0)) * (1.2351 + 0.0105 * celsius)
        return np.where(lwc > 1e-7, 1.5 * lwc / np.clip(drop, 4e-6, 15e-6), 0.0) + np.where(iwc > 1e-7, 1.5 * iwc / np.clip(crystal, 10e-6, 150e-6), 0.0)


def voxels(x, y, z, du, dv, fields: np.ndarray) -> np.ndarray:
    """Extinction of voxels, per metre: FIELDS as sampled (p in kPa) at points with their shear; 0 without cover."""
    f = dict(zip(FIELDS, fields, strict=True))
    clc = np.clip(f["clc"], 0.0, 1.0)
    out = np.where(np.isnan(clc), np.nan, 0.0)
    on = np.flatnonzero(clc > 0.0)
    if len(on):
        x, y, z, du, dv, clc, w, p = (a[on] for a in (x, y, z, du, dv, clc, f["w"], f["p"]))
        tke, qc, qi, qv, t = (np.maximum(f[name][on], 0.0) for name in ("tke", "qc", "qi", "qv", "t"))
        x, y, z = billowed(x, y, z, du, dv, tke)
        x, y = stirred(x, y, z, tke)
        share = density(x, y, z, clc, tke, w)
        out[on] = np.where(share > 0.0, share * extinction(qc, qi, qv, t, p * 1000.0, clc), 0.0)
    return out


def shear_density(x, y, z, clc, tke, w, scales: dict) -> Column:
    """As physics.shear_density, by batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series, clc: pd.Series, tke: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(density(*arrays(x, y, z, clc, tke, w), scales))

    return run(*map(col, (x, y, z, clc, tke, w)))
