"""Neighbourhoods on grids: smoothing, blurring, stencils and vertical differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.interp import bspline_weights, clamp_index, reflect_index
from ..session import ship

#: Voxels that are smoothed together, and at least one level of them.
SLAB = 1 << 19


def _pass(voxels: DataFrame, axis: str, value: str, keys: list[str]) -> DataFrame:
    """Weights 1, 2, 1 along one axis of a dense grid; the edge repeats."""
    along = Window.partitionBy(*keys, *[c for c in ("vz", "vy", "vx") if c != axis]).orderBy(axis)
    v = F.col(value)
    before, after = F.coalesce(F.lag(v).over(along), v), F.coalesce(F.lead(v).over(along), v)
    return voxels.withColumn(value, (before + 2 * v + after) / 4)


def smooth(voxels: DataFrame, value: str = "density", keys: tuple = ()) -> DataFrame:
    """3 x 3 x 3 binomial smoothing of a dense grid, the edge repeated. The kernel is a product, so three passes are exact."""
    for axis in ("vx", "vy", "vz"):
        voxels = _pass(voxels, axis, value, list(keys))
    return voxels


def smooth_direct(voxels: DataFrame, nz: int, ny: int, nx: int, value: str = "density", keys: tuple = ()) -> DataFrame:
    """The same by 27 weighted neighbours of each voxel; for checks of `smooth`.

    Dense volumes are dealt in slabs of levels, about SLAB voxels each, with the level above and below;
    a slab is an array, of which 27 shifted copies are added up.
    """
    ship(voxels.sparkSession)
    high = max(1, SLAB // (ny * nx))
    slab = lambda z: F.floor(z / high).cast("int")
    reach = F.sequence(slab(F.greatest(F.col("vz") - 1, F.lit(0))), slab(F.least(F.col("vz") + 1, F.lit(nz - 1))))
    sent = voxels.select(*keys, "vz", "vy", "vx", value).withColumn("_slab", F.explode(reach))

    def run(part: pa.Table) -> pa.Table:
        first = part["_slab"][0].as_py() * high
        low, up = max(first - 1, 0), min(first + high + 1, nz)
        whole = np.zeros((up - low, ny, nx))
        z, y, x = (part[c].to_numpy() for c in ("vz", "vy", "vx"))
        whole[z - low, y, x] = part[value].to_numpy()
        edge = np.pad(whole, [(int(low == first), int(up == min(first + high, nz))), (1, 1), (1, 1)], "edge")
        n = edge.shape[0] - 2
        out = sum((2 - abs(a)) * (2 - abs(b)) * (2 - abs(c)) / 64 * edge[1 + a : 1 + a + n, 1 + b : 1 + b + ny, 1 + c : 1 + c + nx] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
        own = (z >= first) & (z < first + high)
        return part.filter(pa.array(own)).select([*keys, "vz", "vy", "vx"]).append_column(value, pa.array(out[z[own] - first, y[own], x[own]]))

    schema = StructType([voxels.schema[c] for c in (*keys, "vz", "vy", "vx")] + [StructField(value, DoubleType())])
    return sent.groupBy(*keys, "_slab").applyInArrow(run, schema)


def gauss_weights(sigma: float = 1.0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a truncated Gaussian; weights sum to 1."""
    radius = int(truncate * sigma + 0.5)
    raw = [(i, math.exp(-0.5 * (i / sigma) ** 2)) for i in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(i, w / total) for i, w in raw]


def gauss(grid: DataFrame, axis: str, size: int, keys: list[str], value: str = "value", sigma: float = 1.0) -> DataFrame:
    """Gaussian blur along one axis of a dense grid, reflected at its ends.

    Each line along the axis is gathered into one array of `size` values, which a tile or canvas
    bounds, weighted, and exploded again: one shuffle for all taps.
    """
    if sigma <= 0:
        return grid.select(*keys, axis, value)
    line = grid.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, value))).alias("line"))
    values = F.transform("line", lambda s: s[value])

    def blurred(i):
        total = None
        for offset, w in gauss_weights(sigma):
            term = F.element_at(values, (reflect_index(i + offset, F.lit(size)) + 1).cast("int")) * w
            total = term if total is None else total + term
        return F.struct(i.alias(axis), total.alias(value))

    return line.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), blurred)).alias("c")).select(*keys, f"c.{axis}", f"c.{value}")


def gauss_2d(canvas: DataFrame, height: int, width: int, value: str = "value", sigma: float = 1.0, keys: tuple = ()) -> DataFrame:
    """Gaussian blur of dense canvases (keys, py, px), along both axes."""
    return gauss(gauss(canvas, "px", width, [*keys, "py"], value, sigma), "py", height, [*keys, "px"], value, sigma)


def stencil_16(points: DataFrame, nx: int, ny: int, x: str = "src_x", y: str = "src_y") -> DataFrame:
    """Points with each of their 16 B-spline neighbours: ix, iy, held at the edges, and weight."""
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    wx, wy = F.array(*bspline_weights(fx)), F.array(*bspline_weights(fy))
    at = F.explode(F.sequence(F.lit(0), F.lit(15)))
    near = points.withColumn("_i", at)
    jx, jy = F.col("_i") % 4, F.floor(F.col("_i") / 4).cast("int")
    return near.select(
        *points.columns,
        clamp_index((F.floor(x) + jx - 1).cast("int"), F.lit(nx)).alias("ix"),
        clamp_index((F.floor(y) + jy - 1).cast("int"), F.lit(ny)).alias("iy"),
        (F.element_at(wx, (jx + 1).cast("int")) * F.element_at(wy, jy + 1)).alias("weight"),
    )


def layer_geometry(levels: DataFrame, keys: list[str], height: str = "hhl", level: str = "level") -> DataFrame:
    """Half levels to cells: middle and thickness between a level and the next below."""
    down = Window.partitionBy(*keys).orderBy(level)
    below = F.lead(height).over(down)
    return levels.select("*", ((F.col(height) + below) / 2).alias("h_mid"), (F.col(height) - below).alias("dz")).filter(F.col("dz").isNotNull())


def four_nodes(levels: DataFrame, keys: list[str], columns: list[str], level: str = "level") -> DataFrame:
    """Each level with the values of the level before it and the two after, the edge repeated: name_0 .. name_3."""
    down = Window.partitionBy(*keys).orderBy(level)
    out = levels
    for c in columns:
        v = F.col(c)
        one = F.coalesce(F.lead(v).over(down), v)
        out = out.withColumns({f"{c}_0": F.coalesce(F.lag(v).over(down), v), f"{c}_1": v, f"{c}_2": one, f"{c}_3": F.coalesce(F.lead(v, 2).over(down), one)})
    return out


def wind_shear(samples: DataFrame, keys: list[str], z: str = "vz", least: float = 1.0) -> DataFrame:
    """Vertical shear from the sample before, over at least one metre; 0 at the first."""
    up = Window.partitionBy(*keys).orderBy(z)
    dz = F.greatest(F.col("h") - F.lag("h").over(up), F.lit(least))
    shear = lambda c: F.coalesce((F.col(c) - F.lag(c).over(up)) / dz, F.lit(0.0))
    return samples.withColumns({"du_dz": shear("u"), "dv_dz": shear("v")})
