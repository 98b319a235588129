"""Sampling model columns at points: as-of joins in height, and the voxel kernels.

A model column is one row (iy, ix) with arrays over levels, so that a lookup in height is an array
search within a row. Points meet their 16 columns by tiles of the grid: each point is sent once, each
column to the tiles that reach it, and a tile's points pass by its columns batch by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import kernels, levels, physics, shear
from ..functions.interp import clamp_index, let
from ..session import ship

FIELDS = ("clc", "qc", "qi", "qv", "t", "p")
#: Model columns along each side of a tile, and heights that are sampled at once.
TILE, AT_ONCE = 64, 1024


def columns_of(cube: DataFrame, fields: tuple = ("hhl", *FIELDS, "tke")) -> DataFrame:
    """The long cube (var, level, iy, ix, value) as one row per column, arrays in order of level, top first."""
    level = lambda f: F.array_sort(F.collect_list(F.when(F.col("var") == f, F.struct("level", "value"))))
    held = {f: F.when(F.max(F.col("var") == f), F.transform(level(f), lambda s: s["value"].cast("double"))) for f in fields}
    return cube.filter(F.col("var").isin(*fields)).groupBy("iy", "ix").agg(*[v.alias(f) for f, v in held.items()])


def full_level(hhl: Column, height: Column) -> Column:
    """As-of lookup between cell centres: the lowest cell whose centre is not below the height; the top cell beyond."""
    centres = F.transform(F.sequence(F.lit(0), F.size(hhl) - 2), lambda i: (F.element_at(hhl, i + 1) + F.element_at(hhl, i + 2)) / 2)
    return F.greatest(F.size(F.filter(centres, lambda c: c >= height)) - 1, F.lit(0))


def half_level(hhl: Column, height: Column) -> Column:
    """As-of lookup on half levels: k with hhl[k+1] < height <= hhl[k], held between the first and the last interval."""
    n = F.size(F.filter(hhl, lambda h: h >= height))
    return F.least(F.greatest(n - 1, F.lit(0)), F.size(hhl) - 2)


def asof_level(points: DataFrame, columns: DataFrame) -> DataFrame:
    """Points (iy, ix, height) with `k`, the full level that holds them."""
    return points.join(columns.select("iy", "ix", "hhl"), ["iy", "ix"]).withColumn("k", full_level(F.col("hhl"), F.col("height"))).drop("hhl")


def _by_tile(points: DataFrame, columns: DataFrame, nx: int, ny: int, fields: list[str], run, schema: StructType) -> DataFrame:
    """Rows that `run` makes of points and the columns of their tile: it gets `levels.Columns` and points as a struct array.

    A partition is in order of tiles, columns before points, so a task holds the columns of one tile and one batch,
    however many points meet there. Points without a place are left out.
    """
    ship(points.sparkSession)
    tile = lambda c, n: F.floor(clamp_index(F.floor(c), F.lit(n)) / TILE).cast("int")
    reach = lambda c, n: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - 2, F.lit(0)) / TILE).cast("int"), F.floor(F.least(F.col(c) + 1, F.lit(n - 1)) / TILE).cast("int")))
    asked = points.filter("src_x IS NOT NULL AND src_y IS NOT NULL").select(tile("src_y", ny).alias("_ty"), tile("src_x", nx).alias("_tx"), F.lit(True).alias("_asks"), F.struct(*points.columns).alias("_p"))
    inside = columns.filter(F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1)).select(F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), *fields)
    lent = inside.withColumn("_ty", reach("iy", ny)).withColumn("_tx", reach("ix", nx)).select("_ty", "_tx", F.lit(False).alias("_asks"), F.struct("iy", "ix", *fields).alias("_c"))
    rows = lent.unionByName(asked, allowMissingColumns=True).repartition("_ty", "_tx").sortWithinPartitions("_ty", "_tx", "_asks")

    def stream(batches):
        here, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_ty", "_tx", "_asks")])
            ends = np.flatnonzero(np.append((np.diff(keys) != 0).any(0), batch.num_rows > 0)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                ty, tx, asks = keys[:, a].tolist()
                if (ty, tx) != here:
                    here, parts, held = (ty, tx), [], None
                if not asks:
                    parts.append(batch.column("_c").slice(a, b - a))
                elif parts or held:
                    if held is None:
                        held, parts = levels.Columns(pa.concat_arrays(parts), fields, ty * TILE - 1, tx * TILE - 1, TILE + 3), []
                    yield from run(held, batch.column("_p").slice(a, b - a))

    return rows.select("_ty", "_tx", "_asks", "_c", "_p").mapInArrow(stream, schema)


def _numbers(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [pc.struct_field(rows, n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def _sampled(points: DataFrame, columns: DataFrame, nx: int, ny: int, fields: list[str], kernel, names: list[str]) -> DataFrame:
    """Points that have any model column, with columns `names` that `kernel` (columns, rows, weights, x, y, height) gives; a column of points with such a name is replaced."""
    kept = [c for c in points.columns if c not in names]

    def run(held, rows):
        for i in range(0, len(rows), AT_ONCE):
            part = rows.slice(i, AT_ONCE)
            x, y, h = _numbers(part, "src_x", "src_y", "height")
            row, weight = held.near(x, y, nx, ny)
            got = kernel(held, row, weight, x, y, h)
            out = {c: pc.struct_field(part, c) for c in kept} | {n: pa.array(got[n]) for n in names}
            yield pa.RecordBatch.from_pydict(out).filter(pa.array((row >= 0).any(1)))

    schema = StructType([points.schema[c] for c in kept] + [StructField(n, DoubleType()) for n in names])
    return _by_tile(points, columns, nx, ny, fields, run, schema)


def _with_material(points: DataFrame, columns: DataFrame, nx: int, ny: int, ground: bool = False) -> DataFrame:
    """Points with FIELDS, and with `ground` if asked for."""

    def kernel(held, row, weight, x, y, h):
        sums = levels.material(held, row, weight, h, FIELDS)
        inside = (x >= 0) & (x <= nx - 1) & (y >= 0) & (y <= ny - 1) & (h > 0)
        share = np.where(sums["w"] > 1e-5, sums["w"], 1.0)
        out = {}
        for f in FIELDS:
            v = sums[f] / physics.STORED.get(f, 1.0)
            out[f] = np.where(inside, (v if f in ("clc", "p") else np.maximum(v, 0.0)) / share, 0.0)
        out["clc"] = np.clip(out["clc"], 0.0, 1.0)
        return out | ({"ground": levels.ground(held, row, weight)} if ground else {})

    return _sampled(points, columns, nx, ny, ["hhl", *FIELDS], kernel, [*FIELDS, *["ground"] * ground])


def _with_environment(points: DataFrame, columns: DataFrame, nx: int, ny: int) -> DataFrame:
    """Points with `tke` and `ground`."""

    def kernel(held, row, weight, x, y, h):
        sums = levels.turbulence(held, row, weight, h)
        return {"tke": np.maximum(sums["tke"] / np.where(sums["w"] > 1e-5, sums["w"], 1.0), 0.0), "ground": levels.ground(held, row, weight)}

    return _sampled(points, columns, nx, ny, ["hhl", "tke"], kernel, ["tke", "ground"])


def _places(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.select(*dict.fromkeys([*keys, "src_x", "src_y", "height"]))


def sample_material(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Fields at points (keys, src_x, src_y, height): B-spline across, pchip down.

    Neighbours whose column doesn't span the height are left out and the weights of the others made
    up to 1. Points off the grid or at height 0 and below give zeros. qc, qi, qv come back unscaled and
    p in pascal, as storage scales them.
    """
    return _with_material(_places(points, keys), columns, nx, ny).select(*keys, *FIELDS)


def sample_environment(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """`tke` and `ground` at points, from one stencil.

    tke comes from half levels, the height held above the ground; columns whose top is below are left
    out. The ground is the weighted height of the lowest half level; its weights are not made up to 1.
    """
    return _with_environment(_places(points, keys), columns, nx, ny).select(*keys, "tke", "ground")


def sample_turbulence(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """The tke of `sample_environment` alone."""
    return sample_environment(points, columns, nx, ny, keys).drop("ground")


def ground_height(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Weighted height of the lowest half level; weights are not made up to 1."""
    ground = lambda held, row, weight, x, y, h: {"ground": levels.ground(held, row, weight)}
    return _sampled(_places(points, keys), columns, nx, ny, ["hhl"], ground, ["ground"]).select(*keys, "ground")


def _state(material: DataFrame) -> DataFrame:
    """Material with effective cover and restored condensate."""
    m = material.withColumn("cover", physics.effective_cover("clc", "qc", "qi"))
    m = m.withColumn("q", physics.restored_condensate("cover", "qc", "qi", "t", "p"))
    return m.withColumn("qc", F.col("q.qc")).withColumn("qi", F.col("q.qi")).drop("q")


def synthesise_plain(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Voxels without noise: extinction by cover, faded over the terrain. Points carry keys, src_x, src_y, height."""
    state = _state(_with_material(_places(points, keys), columns, nx, ny, True))
    beta = physics.extinction("qc", "qi", "qv", "t", "p", "cover")
    return state.select(*keys, F.when(F.col("cover") > 0, physics.voxel_plain(beta, "cover", "height", "ground")).otherwise(0.0).alias("density"))


def synthesise(points: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Voxels with turbulent displacement and density factor.

    Points carry keys, src_x, src_y, height, world_x, world_y and to_src_x, to_src_y (texels a metre).
    """
    ship(points.sparkSession)
    moved = _with_environment(points, columns, nx, ny).withColumn("d", kernels.displacement("world_x", "world_y", "height", "tke"))
    place = {"src_x": F.col("src_x") + F.col("d.dx") * F.col("to_src_x"), "src_y": F.col("src_y") - F.col("d.dy") * F.col("to_src_y"), "height": F.col("height") + F.col("d.dz")}
    world = {"tke": F.col("tke"), "ground": F.col("ground"), "asked": F.col("height"), "wx": F.col("world_x") + F.col("d.dx"), "wy": F.col("world_y") + F.col("d.dy")}
    state = _state(_with_material(moved.select(*keys, *[v.alias(c) for c, v in (place | world).items()]), columns, nx, ny))
    beta = physics.extinction("qc", "qi", "qv", "t", "p", "cover")
    factor = kernels.density_factor("wx", "wy", "height", "cover", "tke")
    value = let(F.col("factor"), lambda f: F.when(f > 0, physics.voxel(beta, f, "asked", "ground")).otherwise(0.0))
    return state.withColumn("factor", factor).select(*keys, F.when(F.col("cover") > 0, value).otherwise(0.0).alias("density"))


def _sheared(targets: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str], values: list[str]) -> DataFrame:
    """Rows (keys, z, values) of target columns: height and fields, or density."""
    density = values == ["density"]

    def run(held, rows):
        most = pc.max(pc.list_value_length(pc.struct_field(rows, "heights"))).as_py()
        for i in range(0, len(rows), step := max(1, AT_ONCE // most)):
            part = rows.slice(i, step)
            x, y = _numbers(part, "src_x", "src_y")
            near, weight = held.near(x, y, nx, ny)
            known = (near >= 0).any(1)
            part, near, weight = part.filter(pa.array(known)), near[known], weight[known]
            if not len(part):
                continue
            heights = pc.struct_field(part, "heights")
            n = pc.list_value_length(heights).to_numpy(zero_copy_only=False)
            h = heights.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), n)
            z = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            fields = levels.older(held, near[row], weight[row], h)
            out = {k: pc.struct_field(part, k).take(pa.array(row)) for k in keys} | {"z": pa.array(z, pa.int32())}
            if density:
                du, dv = shear.shear(h, fields[shear.FIELDS.index("u")], fields[shear.FIELDS.index("v")], z == 0)
                east, north = _numbers(part, "world_x", "world_y")
                out["density"] = pa.array(shear.voxels(east[row], north[row], h, du, dv, fields))
            else:
                out |= {"height": pa.array(h)} | {name: pa.array(v) for name, v in zip(shear.FIELDS, fields, strict=True)}
            yield pa.RecordBatch.from_pydict(out)

    schema = StructType([targets.schema[k] for k in keys] + [StructField("z", IntegerType())] + [StructField(v, DoubleType()) for v in values])
    return _by_tile(targets.filter("size(heights) > 0"), columns, nx, ny, ["hhl", *shear.FIELDS], run, schema)


def sample_older(targets: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Fields of the older kernel up whole target columns: a row (keys, z, height, fields) for each height.

    Targets carry keys, src_x, src_y and `heights`, in ascending order. Columns hold arrays of equal
    lengths, w and hhl one longer than cells; values come back as held. Weights aren't made up to 1, neighbours that
    are missing or don't span a height add nothing. A target without heights or without any model column gives no rows. A
    column's neighbours are met once for all its heights, so what is sent grows with columns, not with voxels.
    """
    return _sheared(targets, columns, nx, ny, keys, ["height", *shear.FIELDS])


def synthesise_shear(targets: DataFrame, columns: DataFrame, nx: int, ny: int, keys: list[str]) -> DataFrame:
    """Voxels of the older kernel: sampled up each column, sheared from the sample below, billowed, stirred, eroded.

    As `sample_older`, with world_x and world_y; p is in kPa, other fields in their own units. Density is the
    extinction per metre, 0 without cover.
    """
    return _sheared(targets, columns, nx, ny, keys, ["density"])


def slice_at_altitude(cube: DataFrame, altitude: float, staggered: bool = False) -> DataFrame:
    """Values of a horizontal cut through columns (iy, ix, hhl array, values array).

    Cell values: the first cell whose half levels hold the altitude. Half-level values: the nearest
    level. NaN outside the column.
    """
    hhl, v = F.col("hhl"), F.col("values")
    outside = (F.lit(altitude) < F.element_at(hhl, -1)) | (F.lit(altitude) > F.element_at(hhl, 1))
    if staggered:
        gaps = F.transform(hhl, lambda h: F.abs(h - altitude))
        found = F.element_at(v, F.array_position(gaps, F.array_min(gaps)).cast("int"))
    else:
        hits = F.filter(F.sequence(F.lit(1), F.size(hhl) - 1), lambda k: (F.element_at(hhl, k + 1) <= altitude) & (F.lit(altitude) <= F.element_at(hhl, k)))
        found = F.when(F.size(hits) > 0, F.element_at(v, F.get(hits, F.lit(0))))
    return cube.select("iy", "ix", F.when(outside, F.lit(float("nan"))).otherwise(F.coalesce(found, F.lit(float("nan")))).alias("value"))


def region(grid: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Cells inside a box, both ends included; axes may be named lat, lon or latitude, longitude."""
    lat, lon = ("latitude" if "latitude" in grid.columns else "lat"), ("longitude" if "longitude" in grid.columns else "lon")
    return grid.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def region_indices(grid: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """The index box of cells inside a region of a grid with two-dimensional coordinates; no row if none is."""
    inside = region(grid, south, north, west, east)
    return inside.agg(F.min("iy").alias("iy0"), F.max("iy").alias("iy1"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1")).filter("iy0 is not null")


def axis_figures(axes: DataFrame, value: str) -> DataFrame:
    """Least and largest coordinate, and the number of cells."""
    return axes.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
