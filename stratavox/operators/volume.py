"""Voxel volumes in long form: zoom, tx, ty, vz, vy, vx and a value.

Rows of 256 are the reference size of a tile; `pixels` may differ. Absent voxels count as zero where
an operator says so. All operators are grouped aggregations or windows over (tile, column) keys, so
a volume of any size is dealt by tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

KEYS = ["zoom", "tx", "ty", "vz", "vy", "vx"]


def _half(v) -> Column:
    return F.shiftright(v, 1)


def _parent(voxels: DataFrame, pixels: int) -> DataFrame:
    """Voxels with their place one zoom up, as zoom, tx, ty, vz, vy, vx."""
    px, py = F.col("tx") * pixels + F.col("vx"), F.col("ty") * pixels + F.col("vy")
    return voxels.select(
        (F.col("zoom") - 1).alias("zoom"), _half("tx").alias("tx"), _half("ty").alias("ty"), "vz",
        (_half(py) % pixels).alias("vy"), (_half(px) % pixels).alias("vx"), "density",
    )


def pool_mean(voxels: DataFrame, pixels: int = 256) -> DataFrame:
    """Mean of the 2 x 2 voxels below each voxel of the next zoom; absent ones are 0, so the divisor is always 4."""
    return _parent(voxels, pixels).groupBy(*KEYS).agg((F.sum("density") / 4).alias("density"))


def pool_min(voxels: DataFrame, pixels: int = 256) -> DataFrame:
    """Least of the 2 x 2 voxels below; absent ones are 0."""
    least = F.when(F.count("*") < 4, F.least(F.min("density"), F.lit(0.0))).otherwise(F.min("density"))
    return _parent(voxels, pixels).groupBy(*KEYS).agg(least.alias("density"))


def pyramid(leaves: DataFrame, to_zoom: int, from_zoom: int, pixels: int = 256) -> DataFrame:
    """Leaves and all coarser zooms. Each zoom is pooled from the one below it, which is written, so all zooms together
    cost a third more than the leaves."""
    levels = [leaves.select(*KEYS, "density")]
    for zoom in range(from_zoom - 1, to_zoom - 1, -1):
        levels.append(written(pool_mean(levels[-1], pixels).select(F.lit(zoom).alias("zoom"), *KEYS[1:], "density"), "zoom"))
    return reduce(DataFrame.union, levels)


def halve(voxels: DataFrame, nz: int, ny: int, nx: int, keys: tuple = ()) -> DataFrame:
    """Mean of 2 x 2 x 2 voxels of dense volumes (keys, vz, vy, vx, density); an odd last layer is cut off."""
    whole = voxels.filter((F.col("vz") < nz // 2 * 2) & (F.col("vy") < ny // 2 * 2) & (F.col("vx") < nx // 2 * 2))
    return whole.groupBy(*keys, _half("vz").alias("vz"), _half("vy").alias("vy"), _half("vx").alias("vx")).agg(F.avg("density").alias("density"))


def mip_sizes(nz: int, ny: int, nx: int, least: int = 4) -> list[tuple[int, int, int]]:
    """Sizes of a mip chain: halved until no side exceeds `least`."""
    out = [(nz, ny, nx)]
    while max(out[-1]) > least:
        out.append(tuple(max(1, s // 2) for s in out[-1]))
    return out


def mip_chain(voxels: DataFrame, nz: int, ny: int, nx: int, least: int = 4, keys: tuple = ()) -> DataFrame:
    """All mips of dense volumes with sides that are powers of two: level, keys, vz, vy, vx, density.

    Each mip is averaged from the one before it, which is written.
    """
    sizes, mips = mip_sizes(nz, ny, nx, least), [voxels.select(*keys, "vz", "vy", "vx", "density")]
    for large, small in zip(sizes, sizes[1:], strict=False):
        at = [(_half(c) if b < a else F.col(c)).alias(c) for c, a, b in zip(("vz", "vy", "vx"), large, small, strict=True)]
        mips.append(written(mips[-1].groupBy(*keys, *at).agg(F.avg("density").alias("density")), "mip"))
    return reduce(DataFrame.union, [m.select(F.lit(level).alias("level"), "*") for level, m in enumerate(mips)])


def project(voxels: DataFrame, axis: str, how: str = "max", value: str = "density", keys: tuple = ()) -> DataFrame:
    """Largest, mean or sum along an axis (vz, vy or vx)."""
    rest = [c for c in ("vz", "vy", "vx") if c != axis]
    return voxels.groupBy(*keys, *rest).agg({"max": F.max, "mean": F.avg, "sum": F.sum, "min": F.min}[how](value).alias(value))


def column_sum(voxels: DataFrame, low: int, high: int, keys: tuple = ("zoom", "tx", "ty")) -> DataFrame:
    """Sum over levels low..high-1 of each column."""
    return voxels.filter((F.col("vz") >= low) & (F.col("vz") < high)).groupBy(*keys, "vy", "vx").agg(F.sum("density").alias("density"))


def layers(voxels: DataFrame, n: int, nz: int, keys: tuple = ("zoom", "tx", "ty")) -> DataFrame:
    """Column sums of n equal bands of levels, as `layer`."""
    band = F.least(F.floor(F.col("vz") / (nz // n)), F.lit(n - 1)).cast("int")
    return voxels.groupBy(*keys, band.alias("layer"), "vy", "vx").agg(F.sum("density").alias("density"))


def nan_figures(voxels: DataFrame, value: str = "density", keys: tuple = ()) -> DataFrame:
    """Sum, least and largest of each column without NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    return voxels.groupBy(*keys, "vy", "vx").agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def shadow_height(voxels: DataFrame, nz: int, threshold: float, keys: tuple = ("zoom", "tx", "ty"), upward: bool = True) -> DataFrame:
    """1 - z/nz at the first level, marching in the given direction, where the density summed so far exceeds the threshold; else 0.

    `upward` marches in increasing z, as the volumes are read; the other direction is for volumes
    whose first level is at the top.
    """
    z = F.col("vz") if upward else nz - 1 - F.col("vz")
    march = Window.partitionBy(*keys, "vy", "vx").orderBy("_z").rowsBetween(Window.unboundedPreceding, 0)
    summed = voxels.withColumn("_z", z).withColumn("_sum", F.sum("density").over(march))
    first = F.min(F.when(F.col("_sum") > threshold, F.col("_z")))
    return summed.groupBy(*keys, "vy", "vx").agg(F.coalesce(1.0 - first / nz, F.lit(0.0)).alias("height"))


def shadow_map(voxels: DataFrame, nz: int, threshold: float = 2.0, sharpness: float = 4.0, keys: tuple = ("zoom", "tx", "ty"), upward: bool = True) -> DataFrame:
    """Exponential shadow map: exp(sharpness * height)."""
    return shadow_height(voxels, nz, threshold, keys, upward).withColumn("shadow", F.exp(sharpness * F.col("height")))


def on_canvas(pixels: DataFrame, width: int = 256, south_up: bool = True) -> DataFrame:
    """Tiles side by side: canvas column px and row py from the northernmost tile. Bounds are one small aggregate."""
    ends = pixels.agg(F.min("tx").alias("x0"), F.max("ty").alias("y1"), F.min("ty").alias("y0"))
    row = F.col("y1") - F.col("ty") if south_up else F.col("ty") - F.col("y0")
    placed = pixels.join(F.broadcast(ends))
    return placed.select(((F.col("tx") - F.col("x0")) * width + F.col("vx")).alias("px"), (row * width + F.col("vy")).alias("py"), *[c for c in pixels.columns if c not in ("zoom", "tx", "ty", "vx", "vy")])


def ancestors(tiles: DataFrame, from_zoom: int, to_zoom: int) -> DataFrame:
    """All distinct tiles (zoom, x, y) above tiles (x, y), themselves included."""
    up = tiles.select("x", "y", F.explode(F.sequence(F.lit(to_zoom), F.lit(from_zoom))).alias("zoom"))
    shift = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(from_zoom) - F.col("zoom"))).cast("int")
    return up.select("zoom", shift("x").alias("x"), shift("y").alias("y")).distinct()


def roots(tiles: DataFrame, from_zoom: int, to_zoom: int) -> DataFrame:
    """Distinct tiles of the coarsest zoom, in order."""
    k = from_zoom - to_zoom
    return tiles.select(F.shiftright("x", k).alias("x"), F.shiftright("y", k).alias("y")).distinct().orderBy("x", "y")


def children(tiles: DataFrame) -> DataFrame:
    """The four tiles below each tile, in order left to right, top to bottom."""
    four = F.array(*[F.struct((F.col("x") * 2 + dx).alias("x"), (F.col("y") * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])
    return tiles.select((F.col("zoom") + 1).alias("zoom"), F.posexplode(four).alias("quadrant", "c")).select("zoom", "quadrant", "c.x", "c.y")


def covering_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """Tiles x, y that cover boxes (west, south, east, north)."""
    from ..functions.geo import tile_range

    r = boxes.withColumn("r", tile_range("west", "south", "east", "north", zoom))
    return r.select(F.explode(F.sequence("r.x0", "r.x1")).alias("x"), "r").select("x", F.explode(F.sequence("r.y0", "r.y1")).alias("y"))


def batches(tiles: DataFrame, size: int = 4) -> DataFrame:
    """Tiles with the batch of size x size tiles they fall in, counted from the least tile, and their place in it."""
    ends = tiles.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = lambda c: (F.floor((F.col(c) - F.col(f"{c}0")) / size) * size + F.col(f"{c}0")).cast("int")
    named = tiles.join(F.broadcast(ends)).withColumn("batch_x", at("x")).withColumn("batch_y", at("y"))
    return named.select(*tiles.columns, "batch_x", "batch_y", (F.col("x") - F.col("batch_x")).alias("ix"), (F.col("y") - F.col("batch_y")).alias("iy"))


def batch_to_tiles(pixels: DataFrame, halo: int, tiles: int, width: int = 256) -> DataFrame:
    """Pixels (px, py) of a batch without its halo, by tile of the batch: ix, iy, vx, vy."""
    size = tiles * width
    inner = pixels.filter(F.col("px").between(halo, halo + size - 1) & F.col("py").between(halo, halo + size - 1))
    x, y = F.col("px") - halo, F.col("py") - halo
    return inner.select(F.floor(x / width).cast("int").alias("ix"), F.floor(y / width).cast("int").alias("iy"), F.pmod(x, F.lit(width)).alias("vx"), F.pmod(y, F.lit(width)).alias("vy"), *[c for c in pixels.columns if c not in ("px", "py")])


def flip(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    return voxels.withColumn(axis, size - 1 - F.col(axis))


def plane(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    """One slice across an axis."""
    return voxels.filter(F.col(axis) == index).drop(axis)


def strided(voxels: DataFrame, step: int) -> DataFrame:
    """Every step-th voxel along each axis, for a look at the range of values."""
    return voxels.filter((F.col("vz") % step == 0) & (F.col("vy") % step == 0) & (F.col("vx") % step == 0))


def third_channel(texels: DataFrame) -> DataFrame:
    """Two channels and a third of zeros."""
    return texels.withColumn("b", F.lit(0).cast(texels.schema["r"].dataType))


def every_voxel(tiles: DataFrame, nz: int, ny: int, nx: int) -> DataFrame:
    """All voxels (vz, vy, vx) of each row of `tiles`, whose columns stay."""
    i = F.col("_i")
    cells = tiles.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(nz * ny * nx - 1))))
    return cells.select(*tiles.columns, F.floor(i / (ny * nx)).cast("int").alias("vz"), (F.floor(i / nx) % ny).cast("int").alias("vy"), (i % nx).cast("int").alias("vx"))
