"""Cloud physics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .interp import lerp, saturate, smoothstep
from .noise import _let, fbm, perlin, worley, worley_saturating

#: Condensate at full cover (kg/kg), mixing length and largest displacement (m), freezing point (K).
Q_CRIT, L_MIX, MAX_DISPLACEMENT, FREEZING = 3e-5, 800.0, 500.0, 273.15
#: Gas constant of dry air (J/kg K), densities of water and ice (kg/m3), droplets per cm3.
R_DRY, RHO_WATER, RHO_ICE, DROPLETS = 287.05, 1000.0, 917.0, 200.0
#: Factors that storage applies to fields.
STORED = {"qc": 1e4, "qi": 1e4, "qv": 1e4, "p": 1e-3}


def remap_cover(clc, percent: bool = False) -> Column:
    """Cloud cover: below 0.001 is none, the rest is stretched to 0..1; input may be in percent."""
    v = col(clc) * 0.01 if percent else col(clc)
    return F.when(v < 0.001, 0.0).otherwise((v - 0.001) * (1.0 / (1.0 - 0.001)))


def scale_stored(name: str, value) -> Column:
    """A field as it is stored."""
    return col(value) * STORED.get(name, 1.0)


def is_cloud(clc, qc) -> Column:
    """Voxels that the physics analysis counts; cover in percent."""
    return (col(clc) > 1.0) & (col(qc) > 1e-6)


def displacement(x, y, z, tke) -> Column:
    """Struct of dx, dy, dz: turbulent displacement of a point in metres."""
    sigma = F.sqrt(F.greatest(col(tke) * (2.0 / 3.0), F.lit(0.0)))
    size = saturate(sigma / math.sqrt(10.0 / 3.0)) * MAX_DISPLACEMENT
    p = [col(v) / L_MIX for v in (x, y, z)]
    out = []
    for name, offset in (("dx", (17.3, 0.0, 0.0)), ("dy", (0.0, 31.7, 0.0)), ("dz", (0.0, 0.0, 53.1))):
        noise = fbm(perlin, *[a + o for a, o in zip(p, offset, strict=True)], 2)
        out.append(F.when(sigma <= 0.01, 0.0).otherwise((noise - 0.5) * size).alias(name))
    return F.struct(*out)


def condensate(temp, clc) -> Column:
    """Struct of qc, qi: condensate that goes with a cover, the ice part growing from 0 to -38 degrees."""
    ice = saturate((FREEZING - col(temp)) / 38.0)
    q = col(clc) * Q_CRIT
    return F.struct((q * (1.0 - ice)).alias("qc"), (q * ice).alias("qi"))


def effective_cover(clc, qc, qi) -> Column:
    return F.greatest(col(clc), saturate((col(qc) + col(qi)) / Q_CRIT))


def restored_condensate(clc_eff, qc, qi, temp, pressure) -> Column:
    """Struct of qc, qi: at least what the cover implies, where the state is physical."""
    q = condensate(temp, clc_eff)
    good = (col(clc_eff) > 0) & (col(temp) > 180.0) & (col(pressure) > 100.0)
    return F.struct(F.when(good, F.greatest(col(qc), q["qc"])).otherwise(col(qc)).alias("qc"), F.when(good, F.greatest(col(qi), q["qi"])).otherwise(col(qi)).alias("qi"))


def air_density(temp, pressure, qv) -> Column:
    return F.try_divide(col(pressure), R_DRY * col(temp) * (1.0 + 0.608 * col(qv)))


def liquid_radius(lwc) -> Column:
    """Effective radius (m) of droplets, without limits (Bower and Choularton 1992)."""
    return F.pow(F.greatest(col(lwc), F.lit(0.0)) * 1000.0 * 3.0 / (4.0 * math.pi * DROPLETS), F.lit(1.0 / 3.0)) * 1e-4


def ice_radius(iwc, temp, limited: bool = True) -> Column:
    """Effective radius (m) of ice, without limits of its own (Sun and Rikus 1999, Sun 2001)."""
    t, g = col(temp) - FREEZING, F.greatest(col(iwc), F.lit(0.0)) * 1000.0
    if limited:
        t, g = F.least(F.greatest(t, F.lit(-70.0)), F.lit(-5.0)), F.least(F.greatest(g, F.lit(0.0001)), F.lit(0.3))
    size = 45.8966 * F.pow(g, F.lit(0.2214)) + 0.7957 * F.pow(g, F.lit(0.2535)) * (t + 190.0)
    return size * (1.2351 + 0.0105 * t) * (3.0 * math.sqrt(3.0) / 8.0) * 1e-6


def _extinction(qc, qi, qv, temp, pressure, cover, water: float, ice: float, limited: bool) -> Column:
    """Water contents are named once in a one-element array."""
    share = F.greatest(col(cover), F.lit(0.001))
    rho = air_density(temp, pressure, qv)

    def total(w):
        liquid = F.when(w["lwc"] > 1e-7, 1.5 * w["lwc"] / (water * F.least(F.greatest(liquid_radius(w["lwc"]), F.lit(4e-6)), F.lit(15e-6)))).otherwise(0.0)
        frozen = F.when(w["iwc"] > 1e-7, 1.5 * w["iwc"] / (ice * F.least(F.greatest(ice_radius(w["iwc"], w["t"], limited), F.lit(10e-6)), F.lit(150e-6)))).otherwise(0.0)
        return liquid + frozen

    return _let(F.struct((col(qc) / share * rho).alias("lwc"), (col(qi) / share * rho).alias("iwc"), col(temp).alias("t")), total)


def extinction(qc, qi, qv, temp, pressure, cover) -> Column:
    """Extinction per kilometre of liquid and ice within the cloudy part of a cell."""
    return _extinction(qc, qi, qv, temp, pressure, cover, RHO_WATER, RHO_ICE, True) * 1000.0


def extinction_shear(qc, qi, qv, temp, pressure, cover) -> Column:
    """The shear variant's extinction: no densities, ice without limits."""
    return _extinction(qc, qi, qv, temp, pressure, cover, 1.0, 1.0, False)


def _scaled(noise, x, y, z, xy: float, vertical: float, octaves: int) -> Column:
    return fbm(noise, col(x) / xy, col(y) / xy, col(z) / vertical, octaves)


def density_factor(x, y, z, clc, tke) -> Column:
    """Multiplier of the extinction: a smooth slab in calm air, towers with a cellular surface in turbulent air."""
    names = {
        "clc": col(clc),
        "tke": col(tke),
        "convective": F.greatest(smoothstep(0.05, 0.5, tke) * (1.0 - smoothstep(5000.0, 8000.0, z)), smoothstep(0.8, 1.5, tke)),
        "inside": _scaled(perlin, x, y, z, 2000.0, 1000.0, 2),
        "edge": _scaled(perlin, x, y, z, 3000.0, 2000.0, 2) - 0.5,
        "large": _scaled(perlin, x, y, z, 2200.0, 1500.0, 3) - 0.5,
        "mid": _scaled(perlin, x, y, z, 800.0, 400.0, 3) - 0.5,
        "texture": _scaled(perlin, x, y, z, 1500.0, 2000.0, 4) * _scaled(worley, x, y, z, 600.0, 1300.0, 3) * _scaled(worley, x, y, z, 150.0, 150.0, 3),
    }

    def shape(s):
        slab = s["edge"] * 0.4 * (4.0 * s["clc"] * (1.0 - s["clc"]))
        tower = (0.7 * s["large"] + 0.4 * s["mid"]) * smoothstep(0.0, 0.15, s["clc"]) * 1.5
        return smoothstep(0.0, lerp(1.0, 0.5, s["convective"]), saturate(s["clc"] + lerp(slab, tower, s["convective"])))

    def surface(s):
        def finish(shaped):
            bumps = F.greatest(1.0 + (s["texture"] - 0.125) * 6.0, F.lit(0.3)) * (1.0 - 0.3 * saturate(s["tke"] * 0.5))
            tower = lerp(bumps, 1.0, smoothstep(0.2, 0.8, shaped))
            return shaped * lerp(s["inside"] * 0.4 + 0.6, tower, s["convective"])

        return _let(shape(s), finish)

    return _let(F.struct(*[v.alias(k) for k, v in names.items()]), surface)


def terrain_fade(height, ground) -> Column:
    """Ramp from 0 at the ground to 1 at 200 m above it."""
    return saturate((col(height) - col(ground)) / 200.0)


def voxel(extinct, factor, height, ground) -> Column:
    """Extinction of a voxel: no factor above 2, faded in over the terrain."""
    return col(extinct) * F.least(F.greatest(col(factor), F.lit(0.0)), F.lit(2.0)) * terrain_fade(height, ground)


def voxel_plain(extinct, cover, height, ground) -> Column:
    """The variant without noise: extinction by cover."""
    return col(extinct) * col(cover) * terrain_fade(height, ground)


def billow(x, y, z, du_dz, dv_dz, tke, sensitivity: float) -> Column:
    """Struct of x, y, z: a point moved by Kelvin-Helmholtz billows of a sheared layer."""
    shear = F.sqrt(col(du_dz) * col(du_dz) + col(dv_dz) * col(dv_dz))

    def moved(s):
        strength = saturate((0.25 - 1.0 / (1.0 + s["tke"] * s["shear"] * sensitivity)) / 0.25)
        length = 7.07 * F.least(F.greatest(F.try_divide(F.sqrt(2.0 * s["tke"]), s["shear"]), F.lit(50.0)), F.lit(500.0))
        nx, ny = F.try_divide(s["du"], s["shear"]), F.try_divide(s["dv"], s["shear"])
        phase = (s["x"] * nx + s["y"] * ny) / length * (2.0 * math.pi)
        amplitude = strength * 0.30 * length
        along = F.sin(phase) * amplitude
        return F.struct((s["x"] + along * nx).alias("x"), (s["y"] + along * ny).alias("y"), (s["z"] + F.cos(phase) * amplitude).alias("z"))

    state = F.struct(col(x).alias("x"), col(y).alias("y"), col(z).alias("z"), col(du_dz).alias("du"), col(dv_dz).alias("dv"), F.greatest(col(tke), F.lit(0.0)).alias("tke"), shear.alias("shear"))
    return F.when(shear > 1e-4, _let(state, moved)).otherwise(F.struct(col(x).alias("x"), col(y).alias("y"), col(z).alias("z")))


def shear_density(x, y, z, clc, tke, w, scales: dict) -> Column:
    """The shear variant's density: a blend by updraught, eroded by turbulence, over a soft threshold.

    `scales` gives (horizontal, vertical) lengths for stratus, small, middle, large, detail and perturb.
    """
    noise = lambda kind, name, octaves: _scaled(kind, x, y, z, *scales[name], octaves)
    small, middle, large = (scales[k][0] for k in ("small", "middle", "large"))
    target = lerp(small, large, smoothstep(0.0, 0.8, clc))
    cells = [noise(worley_saturating, k, 2) for k in ("small", "middle", "large")]
    cumulus = F.when(target < middle, lerp(cells[0], cells[1], (target - small) / (middle - small))).otherwise(lerp(cells[1], cells[2], (target - middle) / (large - middle)))
    erosion = saturate(col(tke) * 0.2)
    worn = erosion > 0.01
    base = lerp(noise(perlin, "stratus", 2) * 0.5 + 0.5, cumulus, smoothstep(0.0, 2.0, w)) - F.when(worn, noise(worley_saturating, "detail", 3) * erosion).otherwise(0.0)
    shift = (0.35 - noise(worley_saturating, "perturb", 2)) * 0.2 * smoothstep(0.0, 0.2, clc)
    threshold = 1.0 - col(clc) - F.when(worn, erosion * 0.5).otherwise(0.0) + shift
    return saturate((base - threshold) / F.greatest(col(clc), F.lit(0.15)))


def barometric_density(altitude) -> Column:
    return 1.225 * F.exp(-col(altitude) / 8400.0)


def extinction_legacy(qc, qi, rho) -> Column:
    """An older extinction: powers of water content in g/m3."""
    liquid, ice = (F.greatest(col(q) * col(rho) * 1000.0, F.lit(0.0)) for q in (qc, qi))
    return 140.0 * F.pow(liquid, F.lit(0.7)) + 60.0 * ice


def extinction_analysis(qc, clc) -> Column:
    """The physics analysis' extinction from in-cloud water."""
    return 140.0 * F.pow(F.greatest(col(qc) / F.greatest(col(clc), F.lit(0.01)) * 1000.0, F.lit(0.0)), F.lit(0.7))


def is_cirrus(deepest_base, mass_high, mass_total) -> Column:
    """Clouds above 7 km, wholly or by nine tenths of their mass."""
    return (col(deepest_base) > 7000.0) | F.coalesce(F.try_divide(col(mass_high), col(mass_total)) > 0.9, F.lit(False))


def cirrus_layer(mean_height) -> Column:
    return F.when(col(mean_height) > 11000.0, 2).when(col(mean_height) > 9000.0, 1).otherwise(0)
