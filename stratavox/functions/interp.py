"""Interpolation kernels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def saturate(x) -> Column:
    return F.least(F.greatest(col(x), F.lit(0.0)), F.lit(1.0))


def lerp(a, b, t) -> Column:
    return col(a) + col(t) * (col(b) - col(a))


def smoothstep(low, high, x) -> Column:
    """Cubic ramp from 0 at `low` to 1 at `high`; a ramp of no width is a step."""
    width = col(high) - col(low)
    t = saturate(F.when(width == 0, F.when(col(x) >= col(low), 1.0).otherwise(0.0)).otherwise(F.try_divide(col(x) - col(low), width)))
    return t * t * (3.0 - 2.0 * t)


def clamp_index(i, n) -> Column:
    """An index held inside 0..n-1, which repeats the edge."""
    return F.least(F.greatest(col(i), F.lit(0)), col(n) - 1)


def reflect_index(i, n) -> Column:
    """An index reflected at the outer sides of the edge cells."""
    m = F.pmod(col(i), 2 * col(n))
    return F.least(m, 2 * col(n) - 1 - m)


def bspline_weights(t) -> list[Column]:
    """Weights of the uniform cubic B-spline for the four cells around a fraction; they sum to 1."""
    t = col(t)
    u = 1.0 - t
    return [u * u * u / 6.0, (4.0 - 6.0 * t * t + 3.0 * t * t * t) / 6.0, (4.0 - 6.0 * u * u + 3.0 * u * u * u) / 6.0, t * t * t / 6.0]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: it is the only element of an array."""
    return F.transform(F.array(value), body)[0]


def monotone_tangent(h_left, h_right, s_left, s_right) -> Column:
    """Weighted harmonic mean of two slopes; 0 where they differ in sign."""
    a, b = 2.0 * h_right + h_left, h_right + 2.0 * h_left
    return F.when(s_left * s_right <= 0, F.lit(0.0)).otherwise(F.try_divide((a + b) * s_left * s_right, a * s_right + b * s_left))


def pchip(z: list, v: list, at) -> Column:
    """Monotone cubic through the middle two of four nodes, heights descending; the outer two give the slopes.

    Nodes that coincide give the upper value. Tangents that would overshoot are scaled back
    (Fritsch and Carlson 1980). Each step is named, so that the expression doesn't grow with its uses.
    """
    names = {f"z{i}": col(x) for i, x in enumerate(z)} | {f"v{i}": col(x) for i, x in enumerate(v)} | {"at": col(at)}
    nodes = F.struct(*[x.cast("double").alias(k) for k, x in names.items()])

    def slopes(n):
        h = [n[f"z{i}"] - n[f"z{i + 1}"] for i in range(3)]
        outer = lambda i: F.when(h[i] > 1e-3, F.try_divide(n[f"v{i}"] - n[f"v{i + 1}"], h[i])).otherwise(0.0)
        parts = {"h0": h[0], "h1": h[1], "h2": h[2], "s0": outer(0), "s1": F.try_divide(n["v1"] - n["v2"], h[1]), "s2": outer(2), "t": F.try_divide(n["z1"] - n["at"], h[1]), "v1": n["v1"], "v2": n["v2"]}
        return let(F.struct(*[x.alias(k) for k, x in parts.items()]), tangents)

    def tangents(p):
        ends = F.struct(monotone_tangent(p["h0"], p["h1"], p["s0"], p["s1"]).alias("up"), monotone_tangent(p["h1"], p["h2"], p["s1"], p["s2"]).alias("down"))
        return let(ends, lambda m: _hermite(p, m))

    def _hermite(p, m):
        steep = F.sqrt(m["up"] * m["up"] + m["down"] * m["down"])
        limit = F.when((F.abs(p["s1"]) > 1e-10) & (steep > 3.0 * F.abs(p["s1"])), F.try_divide(3.0 * F.abs(p["s1"]), steep)).otherwise(1.0)
        t, u = p["t"], 1.0 - p["t"]
        value = u * u * (1.0 + 2.0 * t) * p["v1"] + t * t * (3.0 - 2.0 * t) * p["v2"] - p["h1"] * limit * (t * u * u * m["up"] - t * t * u * m["down"])
        return F.when(F.abs(p["h1"]) < 1e-3, p["v1"]).otherwise(value)

    return let(nodes, slopes)


def pchip_plain(z: list, v: list, at) -> Column:
    """The older form of pchip: no guard for nodes that coincide, so such intervals give null."""
    z, v, at = [col(x) for x in z], [col(x) for x in v], col(at)
    return F.when(z[1] - z[2] != 0, pchip(z, v, at))
