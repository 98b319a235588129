"""Procedural noise as columns. Unsigned 32-bit values are BIGINT held below 2**32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

MASK = 4294967295
#: Multipliers of the lattice hash.
PRIMES = (0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35)
#: Gradient directions by the hash's low four bits.
GRADIENTS = [
    (1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1),
    (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1), (1, 1, 0), (-1, 1, 0), (0, 1, 1), (0, -1, 1),
]


def u32(x) -> Column:
    """A whole number's low 32 bits; negative numbers keep their sign bits."""
    return col(x).cast("long").bitwiseAND(F.lit(MASK).cast("long"))


def times_u32(x: Column, k: int) -> Column:
    """Product with a constant, modulo 2**32: in halves, so that no product leaves 64 bits."""
    low, high = x.bitwiseAND(F.lit(65535).cast("long")), F.shiftright(x, 16)
    return (low * F.lit(k).cast("long") + F.shiftleft((high * F.lit(k & 65535).cast("long")).bitwiseAND(F.lit(65535).cast("long")), 16)).bitwiseAND(F.lit(MASK).cast("long"))


def hash3(x, y, z) -> Column:
    """Hash of three unsigned 32-bit columns."""
    a, b, c = (times_u32(u32(v), k) for v, k in zip((x, y, z), PRIMES, strict=True))
    return _finish(a.bitwiseXOR(b).bitwiseXOR(c))


def _finish(h: Column) -> Column:
    """Final avalanche. `transform` over one element names each step once, so that expressions stay small."""
    step = F.transform(F.array(h), lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    step = F.transform(step, lambda v: times_u32(v, PRIMES[1]))
    step = F.transform(step, lambda v: v.bitwiseXOR(F.shiftright(v, 13)))
    step = F.transform(step, lambda v: times_u32(v, PRIMES[2]))
    return F.transform(step, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))[0]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _gradient(axis: int, h: Column) -> Column:
    """One component of the direction that a hash chooses."""
    return F.element_at(F.array(*[F.lit(float(g[axis])) for g in GRADIENTS]), (h.bitwiseAND(F.lit(15).cast("long")) + 1).cast("int"))


def _cell(x, y, z) -> Column:
    """Lattice cell and fractions of a point."""
    parts = {}
    for name, v in zip("xyz", (col(x), col(y), col(z)), strict=True):
        parts |= {f"i{name}": F.floor(v).cast("long"), f"f{name}": v - F.floor(v)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def perlin(x, y, z) -> Column:
    """Gradient noise around 0.5: the eight corners of the cell, weighted by a quintic fade along each axis.

    Corners are elements of one array, so that the expression holds one corner, not eight.
    """

    def weight(t: Column, d: Column) -> Column:
        fade = t * t * t * (t * (t * 6.0 - 15.0) + 10.0)
        return F.when(d == 1, fade).otherwise(1.0 - fade)

    def at(c):
        def corner(i):
            d = [i.bitwiseAND(F.lit(1)), F.shiftright(i, 1).bitwiseAND(F.lit(1)), F.shiftright(i, 2)]
            share = weight(c["fx"], d[0]) * weight(c["fy"], d[1]) * weight(c["fz"], d[2])
            return _let(hash3(c["ix"] + d[0], c["iy"] + d[1], c["iz"] + d[2]), lambda h: share * (_gradient(0, h) * (c["fx"] - d[0]) + _gradient(1, h) * (c["fy"] - d[1]) + _gradient(2, h) * (c["fz"] - d[2])))

        return 0.5 + 0.5 * F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), corner), F.lit(0.0), lambda total, v: total + v)

    return _let(_cell(x, y, z), at)


def nearest_squared(x, y, z) -> Column:
    """Squared distance to the nearest of the points hashed into the 27 cells around."""

    def at(c):
        def distance(i):
            dx, dy, dz = (i % 3) - 1, (F.floor(i / 3).cast("int") % 3) - 1, F.floor(i / 9).cast("int") - 1

            def squared(h):
                def part(name, d, k):
                    p = d + h[k].bitwiseAND(F.lit(65535).cast("long")) / 65535.0 - c[f"f{name}"]
                    return p * p

                return part("x", dx, 0) + part("y", dy, 1) + part("z", dz, 2)

            first = hash3(c["ix"] + dx, c["iy"] + dy, c["iz"] + dz)
            zero = F.lit(0).cast("long")
            three = _let(first, lambda a: _let(hash3(a, zero, zero), lambda b: F.array(a, b, hash3(b, zero, zero))))
            return _let(three, squared)

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(26)), distance))

    return _let(_cell(x, y, z), at)


def worley(x, y, z) -> Column:
    """Cellular noise: 1 less the distance to the nearest point."""
    return 1.0 - F.sqrt(nearest_squared(x, y, z))


def worley_squared(x, y, z) -> Column:
    """Cellular noise of squared distance; lies high."""
    return 1.0 - nearest_squared(x, y, z)


def _octaves(noise, x, y, z, octaves: int, shift: float) -> Column:
    """Sum of octaves of a noise less a shift: each halves the amplitude and doubles the frequency."""

    def add(p):
        def one(total, i):
            k = F.pow(F.lit(2.0), i)
            return total + (noise(p["x"] * k, p["y"] * k, p["z"] * k) - shift) * (0.5 / k)

        return F.aggregate(F.sequence(F.lit(0), F.lit(octaves - 1)), F.lit(0.0), one)

    return _let(F.struct(col(x).alias("x"), col(y).alias("y"), col(z).alias("z")), add)


def fbm(noise, x, y, z, octaves: int) -> Column:
    """Octaves of a noise around 0.5."""
    return _octaves(noise, x, y, z, octaves, 0.5) + 0.5


def fbm_normal(noise, x, y, z, octaves: int) -> Column:
    """The older form: octaves of the noise itself, divided by the sum of amplitudes."""
    return _octaves(noise, x, y, z, octaves, 0.0) / (1.0 - 0.5**octaves)


def worley_saturating(x, y, z) -> Column:
    """The older cellular noise: negative cells count as 0 and no distance exceeds 1."""
    cell = [F.greatest(F.floor(col(v)), F.lit(0)) for v in (x, y, z)]
    shifted = [c + (col(v) - F.floor(col(v))) for c, v in zip(cell, (x, y, z), strict=True)]
    return 1.0 - F.sqrt(F.least(nearest_squared(*shifted), F.lit(1.0)))
