"""Queries over volumes, stencils, samples, statistics and codecs."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import bc4, components, lod, sample, stats, stencil, volume
from ..schemas import VARIABLES, variables
from ..session import ship
from ..sources import grib2, ktx2, raw_tiles, sinks, tile_store
from ..storage import scratch
from .base import CELLS_SQL, COLUMNS_SQL, GRID_SQL, LEVELS, ODD, PARTS, PIXELS, POINTS_SQL, SAMPLES_SQL, VOXELS_SQL, ZOOM, cells, columns, full_levels, grid, grid_sql, half_levels, points, query, samples, shape, table, voxels, wind_columns
from .q_functions import PCHIP_SQL

V = f"WITH {VOXELS_SQL}"
G = f"WITH {VOXELS_SQL}, {GRID_SQL}"
G_ODD = f"WITH {VOXELS_SQL}, {grid_sql(*ODD)}"
#: The volumes of a grid are told apart by their column of tiles.
TX = ("tx",)
VOX = "zoom:i tx:i ty:i vz:i vy:i vx:i density:d"

_PARENT = "parent AS (SELECT zoom - 1 AS zoom, tx // 2 AS tx, ty // 2 AS ty, vz, ((ty * 16 + vy) // 2) % 16 AS vy, ((tx * 16 + vx) // 2) % 16 AS vx, density FROM voxels)"


@query("lod_pool_mean", VOX, f"{V}, {_PARENT} SELECT zoom, tx, ty, vz, vy, vx, sum(density) / 4 AS density FROM parent GROUP BY ALL")
def lod_pool_mean(spark, sf):
    return volume.pool_mean(voxels(spark, sf), PIXELS)


@query("lod_pool_min", VOX, f"{V}, {_PARENT} SELECT zoom, tx, ty, vz, vy, vx, CASE WHEN count(*) < 4 THEN least(min(density), 0.0) ELSE min(density) END AS density FROM parent GROUP BY ALL")
def lod_pool_min(spark, sf):
    return volume.pool_min(voxels(spark, sf), PIXELS)


_TREE = "\nUNION ALL ".join(f"SELECT {10 - k} AS zoom, tx // {2**k} AS tx, ty // {2**k} AS ty, vz, ((ty * 16 + vy) // {2**k}) % 16 AS vy, ((tx * 16 + vx) // {2**k}) % 16 AS vx, sum(density) / {4.0**k} AS density FROM voxels GROUP BY ALL" for k in (1, 2))


@query("lod_tree", VOX, f"{V} SELECT zoom, tx, ty, vz, vy, vx, density FROM voxels UNION ALL {_TREE}")
def lod_tree(spark, sf):
    return volume.pyramid(voxels(spark, sf), ZOOM - 2, ZOOM, PIXELS)


@query("halve", "tx:i vz:i vy:i vx:i density:d", f"{G_ODD} SELECT tx, vz // 2 AS vz, vy // 2 AS vy, vx // 2 AS vx, avg(density) AS density FROM grid WHERE vz < 6 AND vy < 14 AND vx < 12 GROUP BY ALL")
def halve(spark, sf):
    return volume.halve(grid(spark, sf, *ODD), *ODD, TX)


_MIPS = "\nUNION ALL ".join(f"SELECT {k} AS level, tx, vz // {min(2**k, 8)} AS vz, vy // {2**k} AS vy, vx // {2**k} AS vx, avg(density) AS density FROM grid GROUP BY ALL" for k in (0, 1, 2))


@query("mip_chain", "level:i tx:i vz:i vy:i vx:i density:d", f"{G} {_MIPS}")
def mip_chain(spark, sf):
    return volume.mip_chain(grid(spark, sf), LEVELS, PIXELS, PIXELS, keys=TX)


@query("mip_sizes", "level:i nz:i ny:i nx:i", "SELECT l AS level, greatest(1, 64 >> l) AS nz, greatest(1, 256 >> l) AS ny, greatest(1, 256 >> l) AS nx FROM (SELECT CAST(i AS INT) AS l FROM range(7) t(i))")
def mip_sizes(spark, sf):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(volume.mip_sizes(64, 256, 256))], "level int, nz int, ny int, nx int")


@query("column_projection", "zoom:i tx:i ty:i vy:i vx:i density:d", f"{V} SELECT zoom, tx, ty, vy, vx, sum(density) AS density FROM voxels WHERE vz >= 2 AND vz < 6 GROUP BY ALL")
def column_projection(spark, sf):
    return volume.column_sum(voxels(spark, sf), 2, 6)


@query("axis_projection", "tx:i axis:s a:i b:i most:d mean:d", f"{G} SELECT tx, 'vx' AS axis, vz AS a, vy AS b, max(density) AS most, avg(density) AS mean FROM grid GROUP BY ALL UNION ALL SELECT tx, 'vz', vy, vx, max(density), avg(density) FROM grid GROUP BY ALL")
def axis_projection(spark, sf):
    g = grid(spark, sf)
    out = None
    for axis, a, b in (("vx", "vz", "vy"), ("vz", "vy", "vx")):
        both = volume.project(g, axis, "max", keys=TX).withColumnRenamed("density", "most").join(volume.project(g, axis, "mean", keys=TX).withColumnRenamed("density", "mean"), [*TX, a, b])
        part = both.select("tx", F.lit(axis).alias("axis"), F.col(a).alias("a"), F.col(b).alias("b"), "most", "mean")
        out = part if out is None else out.union(part)
    return out


@query("layer_composite", "tx:i layer:i vy:i vx:i density:d total:d", f"{G}, l AS (SELECT tx, least(vz // 2, 2) AS layer, vy, vx, sum(density) AS density FROM grid GROUP BY ALL) SELECT tx, layer, vy, vx, density, sum(density) OVER (PARTITION BY tx, vy, vx) AS total FROM l")
def layer_composite(spark, sf):
    bands = volume.layers(grid(spark, sf), 3, 6, TX)
    return bands.withColumn("total", F.sum("density").over(Window.partitionBy(*TX, "vy", "vx")))


@query("nan_figures", "tx:i vy:i vx:i total:d least:d most:d", f"{G} SELECT tx, vy, vx, coalesce(sum(density) FILTER (vz % 3 > 0), 0) AS total, min(density) FILTER (vz % 3 > 0) AS least, max(density) FILTER (vz % 3 > 0) AS most FROM grid GROUP BY ALL")
def nan_figures(spark, sf):
    return volume.nan_figures(grid(spark, sf).withColumn("density", F.when(F.col("vz") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("density"))), keys=TX)


def _shadow_sql(z: str) -> str:
    return f"{V}, s AS (SELECT zoom, tx, ty, vy, vx, {z} AS z, sum(density) OVER (PARTITION BY zoom, tx, ty, vy, vx ORDER BY {z}) AS c FROM voxels), h AS (SELECT zoom, tx, ty, vy, vx, coalesce(1 - min(CASE WHEN c > 2.0 THEN z END) / 8.0, 0.0) AS height FROM s GROUP BY ALL)"


@query("shadow_height", "zoom:i tx:i ty:i vy:i vx:i height:d", f"{_shadow_sql('7 - vz')} SELECT * FROM h")
def shadow_height(spark, sf):
    return volume.shadow_height(voxels(spark, sf), LEVELS, 2.0, upward=False)


@query("shadow_esm", "zoom:i tx:i ty:i vy:i vx:i height:d shadow:d", f"{_shadow_sql('vz')} SELECT *, exp(4.0 * height) AS shadow FROM h")
def shadow_esm(spark, sf):
    return volume.shadow_map(voxels(spark, sf), LEVELS)


@query("canvas_place", "px:i py:i density:d", f"{V}, p AS (SELECT tx, ty, vy, vx, sum(density) AS density FROM voxels GROUP BY ALL) SELECT (tx - (SELECT min(tx) FROM p)) * 16 + vx AS px, ((SELECT max(ty) FROM p) - ty) * 16 + vy AS py, density FROM p")
def canvas_place(spark, sf):
    flat = voxels(spark, sf).groupBy("tx", "ty", "vy", "vx").agg(F.sum("density").alias("density"))
    return volume.on_canvas(flat, PIXELS)


_TILES = f"WITH {POINTS_SQL}, tiles AS (SELECT DISTINCT CAST(floor((lon + 180.0) / 360.0 * 1024) AS INT) AS x, CAST(floor((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 1024) AS INT) AS y FROM points)"


def _tiles(spark, sf):
    from ..functions import geo

    return points(spark, sf).select(F.floor(geo.tile_x("lon", 10)).cast("int").alias("x"), F.floor(geo.tile_y("lat", 10)).cast("int").alias("y")).distinct()


@query("ancestor_tiles", "zoom:i x:i y:i", f"{_TILES} SELECT DISTINCT z AS zoom, x >> (10 - z) AS x, y >> (10 - z) AS y FROM tiles, (SELECT CAST(i AS INT) AS z FROM range(4, 11) t(i))")
def ancestor_tiles(spark, sf):
    return volume.ancestors(_tiles(spark, sf), 10, 4)


@query("root_tiles", "x:i y:i", f"{_TILES} SELECT DISTINCT x >> 4 AS x, y >> 4 AS y FROM tiles")
def root_tiles(spark, sf):
    return volume.roots(_tiles(spark, sf), 10, 6)


@query("child_tiles", "zoom:i quadrant:i x:i y:i", f"{_TILES} SELECT 11 AS zoom, q AS quadrant, x * 2 + q % 2 AS x, y * 2 + q // 2 AS y FROM tiles, (SELECT CAST(i AS INT) AS q FROM range(4) t(i))")
def child_tiles(spark, sf):
    return volume.children(_tiles(spark, sf).withColumn("zoom", F.lit(10)))


@query("tile_batches", "x:i y:i batch_x:i batch_y:i ix:i iy:i", f"{_TILES}, e AS (SELECT min(x) AS x0, min(y) AS y0 FROM tiles) SELECT x, y, x0 + (x - x0) // 4 * 4 AS batch_x, y0 + (y - y0) // 4 * 4 AS batch_y, (x - x0) % 4 AS ix, (y - y0) % 4 AS iy FROM tiles, e")
def tile_batches(spark, sf):
    return volume.batches(_tiles(spark, sf))


@query("batch_tiles", "ix:i iy:i vx:i vy:i n:i", "SELECT (px - 2) // 8 AS ix, (py - 2) // 8 AS iy, (px - 2) % 8 AS vx, (py - 2) % 8 AS vy, count(*) AS n FROM (SELECT CAST(l_partkey % 20 AS INT) AS px, CAST(l_suppkey % 20 AS INT) AS py FROM lineitem) WHERE px BETWEEN 2 AND 17 AND py BETWEEN 2 AND 17 GROUP BY ALL")
def batch_tiles(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_partkey") % 20).cast("int").alias("px"), (F.col("l_suppkey") % 20).cast("int").alias("py"))
    return volume.batch_to_tiles(p, 2, 2, 8).groupBy("ix", "iy", "vx", "vy").agg(F.count("*").alias("n"))


_COVER_TILES = """WITH b AS (SELECT DISTINCT CAST(c_custkey % 50 AS INT) AS i FROM customer), f AS (SELECT i, 9.4 + i * 0.1 AS w, 46.3 + i * 0.02 AS s, 10.4 + i * 0.1 AS e, 46.8 + i * 0.02 AS n FROM b),
r AS (SELECT i, CAST(floor((w + 180) / 360 * 256) AS INT) AS x0, CAST(floor((e - 1e-11 + 180) / 360 * 256) AS INT) AS x1, CAST(floor((1 - asinh(tan(radians(n))) / pi()) / 2 * 256) AS INT) AS y0, CAST(floor((1 - asinh(tan(radians(s + 1e-11))) / pi()) / 2 * 256) AS INT) AS y1 FROM f)
SELECT x, y, count(*) AS boxes FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) GROUP BY ALL"""


@query("covering_tiles", "x:i y:i boxes:i", _COVER_TILES)
def covering_tiles(spark, sf):
    i = F.col("i")
    b = table(spark, sf, "customer").select((F.col("c_custkey") % 50).cast("int").alias("i")).distinct()
    boxes = b.select((9.4 + i * 0.1).alias("west"), (46.3 + i * 0.02).alias("south"), (10.4 + i * 0.1).alias("east"), (46.8 + i * 0.02).alias("north"))
    return volume.covering_tiles(boxes, 8).groupBy("x", "y").agg(F.count("*").alias("boxes"))


@query("flipped_plane", "tx:i vz:i vx:i density:d", f"{G} SELECT tx, vz, vx, density FROM grid WHERE 15 - vy = 5")
def flipped_plane(spark, sf):
    return volume.plane(volume.flip(grid(spark, sf), "vy", PIXELS), "vy", 5)


@query("strided_range", "n:i least:d most:d", f"{G} SELECT count(*) AS n, min(density) AS least, max(density) AS most FROM grid WHERE vz % 3 = 0 AND vy % 3 = 0 AND vx % 3 = 0")
def strided_range(spark, sf):
    return volume.strided(grid(spark, sf), 3).agg(F.count("*").alias("n"), F.min("density").alias("least"), F.max("density").alias("most"))


@query("third_channel", "k:i r:i g:i b:i", "SELECT p_partkey AS k, p_size AS r, p_partkey % 256 AS g, 0 AS b FROM part")
def third_channel(spark, sf):
    return volume.third_channel(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("r"), (F.col("p_partkey") % 256).alias("g")))


# --- stencils -----------------------------------------------------------------------------------


def _gauss_sql(source: str, axis: str, other: str, size: int, out: str, key: str = "") -> str:
    total = sum(w for _, w in [(i, 2.718281828459045 ** (-0.5 * i * i)) for i in range(-4, 5)])
    at = f"(({axis} + o) % {2 * size} + {2 * size}) % {2 * size}"
    more, same = (f"g.{key}, ", f" AND s.{key} = g.{key}") if key else ("", "")
    return f"{out} AS (SELECT {more}g.{axis}, g.{other}, sum(exp(-0.5 * o * o) / {total!r} * s.value) AS value FROM (SELECT {more.removeprefix('g.')}{axis}, {other}, o, least({at}, {2 * size - 1} - {at}) AS i FROM {source}, (SELECT CAST(i - 4 AS INT) AS o FROM range(9) t(i))) g JOIN {source} s ON s.{axis} = g.i AND s.{other} = g.{other}{same} GROUP BY ALL)"


_CANVAS = "canvas AS (SELECT tx, vy AS py, vx AS px, sum(density) AS value FROM grid GROUP BY ALL)"


def _canvas(spark, sf):
    return volume.project(grid(spark, sf), "vz", "sum", keys=TX).select("tx", F.col("vy").alias("py"), F.col("vx").alias("px"), F.col("density").alias("value"))


@query("gauss_x", "tx:i py:i px:i value:d", f"{G}, {_CANVAS}, {_gauss_sql('canvas', 'px', 'py', 16, 'gx', 'tx')} SELECT * FROM gx")
def gauss_x(spark, sf):
    return stencil.gauss(_canvas(spark, sf), "px", PIXELS, [*TX, "py"])


@query("gauss_2d", "tx:i py:i px:i value:d", f"{G}, {_CANVAS}, {_gauss_sql('canvas', 'px', 'py', 16, 'gx', 'tx')}, {_gauss_sql('gx', 'py', 'px', 16, 'gy', 'tx')} SELECT * FROM gy")
def gauss_2d(spark, sf):
    return stencil.gauss_2d(_canvas(spark, sf), PIXELS, PIXELS, keys=TX)


_SMOOTH = f"""{G}, o AS (SELECT CAST(i // 9 - 1 AS INT) AS dz, CAST((i // 3) % 3 - 1 AS INT) AS dy, CAST(i % 3 - 1 AS INT) AS dx FROM range(27) t(i)),
n AS MATERIALIZED (SELECT tx, vz, vy, vx, (2 - abs(dz)) * (2 - abs(dy)) * (2 - abs(dx)) / 64.0 AS w, least(greatest(vz + dz, 0), 7) AS sz, least(greatest(vy + dy, 0), 15) AS sy, least(greatest(vx + dx, 0), 15) AS sx FROM grid, o)
SELECT n.tx, n.vz, n.vy, n.vx, sum(n.w * s.density) AS density FROM n JOIN grid s ON s.tx = n.tx AND s.vz = sz AND s.vy = sy AND s.vx = sx GROUP BY ALL"""


@query("smooth_3x3x3", "tx:i vz:i vy:i vx:i density:d", _SMOOTH)
def smooth(spark, sf):
    return stencil.smooth(grid(spark, sf), keys=TX)


@query("smooth_27", "tx:i vz:i vy:i vx:i density:d", _SMOOTH)
def smooth_27(spark, sf):
    return stencil.smooth_direct(grid(spark, sf), LEVELS, PIXELS, PIXELS, keys=TX)


@query("layer_geometry", "iy:i ix:i level:i h_mid:d dz:d", f"WITH {COLUMNS_SQL} SELECT iy, ix, level, (hhl + n) / 2 AS h_mid, hhl - n AS dz FROM (SELECT *, lead(hhl) OVER (PARTITION BY iy, ix ORDER BY level) AS n FROM half_levels) WHERE n IS NOT NULL")
def layer_geometry(spark, sf):
    return stencil.layer_geometry(half_levels(spark, sf), ["iy", "ix"])


@query("wind_shear", "tx:i vy:i vx:i vz:i du_dz:d dv_dz:d", f"{G} SELECT tx, vy, vx, vz, coalesce((u - lag(u) OVER w) / greatest(h - lag(h) OVER w, 1.0), 0) AS du_dz, coalesce((v - lag(v) OVER w) / greatest(h - lag(h) OVER w, 1.0), 0) AS dv_dz FROM (SELECT *, density AS u, density * 0.5 + vz AS v, vz * vz * 0.7 AS h FROM grid) WINDOW w AS (PARTITION BY tx, vy, vx ORDER BY vz)")
def wind_shear(spark, sf):
    g = grid(spark, sf).select("tx", "vy", "vx", "vz", F.col("density").alias("u"), (F.col("density") * 0.5 + F.col("vz")).alias("v"), (F.col("vz") * F.col("vz") * 0.7).alias("h"))
    return stencil.wind_shear(g, [*TX, "vy", "vx"])


@query("four_nodes", "iy:i ix:i level:i t_0:d t_1:d t_2:d t_3:d", f"WITH {COLUMNS_SQL} SELECT iy, ix, level, coalesce(lag(t) OVER w, t) AS t_0, t AS t_1, coalesce(lead(t) OVER w, t) AS t_2, coalesce(lead(t, 2) OVER w, lead(t) OVER w, t) AS t_3 FROM full_levels WINDOW w AS (PARTITION BY iy, ix ORDER BY level)")
def four_nodes(spark, sf):
    return stencil.four_nodes(full_levels(spark, sf), ["iy", "ix"], ["t"])


# --- samples --------------------------------------------------------------------------------------

_AT = "places AS (SELECT k, CAST(floor(src_y) AS INT) AS iy, CAST(floor(src_x) AS INT) AS ix, height FROM samples)"


@query("asof_level", "k:i full_k:i half_k:i", f"WITH {COLUMNS_SQL}, {SAMPLES_SQL}, {_AT}, c AS (SELECT iy, ix, level, hhl, (hhl + lead(hhl) OVER (PARTITION BY iy, ix ORDER BY level)) / 2 AS mid FROM half_levels) SELECT k, coalesce(max(level) FILTER (mid >= height), 0) AS full_k, least(coalesce(max(level) FILTER (hhl >= height), 0), 9) AS half_k FROM places JOIN c USING (iy, ix) GROUP BY k")
def asof_level(spark, sf):
    at = samples(spark, sf).select("k", F.floor("src_y").cast("int").alias("iy"), F.floor("src_x").cast("int").alias("ix"), "height")
    return _levels(at, spark, sf)


def _levels(at, spark, sf):
    joined = at.join(columns(spark, sf).select("iy", "ix", "hhl"), ["iy", "ix"])
    return joined.select("k", sample.full_level(F.col("hhl"), F.col("height")).alias("full_k"), sample.half_level(F.col("hhl"), F.col("height")).alias("half_k"))


_STENCIL = """near AS (SELECT k, src_x, src_y, height, least(greatest(CAST(floor(src_x) AS INT) + jx - 1, 0), 11) AS ix, least(greatest(CAST(floor(src_y) AS INT) + jy - 1, 0), (SELECT max(iy) FROM half_levels)) AS iy,
  wx[jx + 1] * wy[jy + 1] AS w FROM (SELECT *, src_x - floor(src_x) AS fx, src_y - floor(src_y) AS fy FROM samples) q,
  LATERAL (SELECT [(1 - fx) ** 3 / 6, (3 * fx ** 3 - 6 * fx ** 2 + 4) / 6, (-3 * fx ** 3 + 3 * fx ** 2 + 3 * fx + 1) / 6, fx ** 3 / 6] AS wx, [(1 - fy) ** 3 / 6, (3 * fy ** 3 - 6 * fy ** 2 + 4) / 6, (-3 * fy ** 3 + 3 * fy ** 2 + 3 * fy + 1) / 6, fy ** 3 / 6] AS wy),
  (SELECT CAST(i % 4 AS INT) AS jx, CAST(i // 4 AS INT) AS jy FROM range(16) t(i))),
hcol AS (SELECT iy, ix, list(hhl ORDER BY level) AS hhl, list(tke ORDER BY level) AS tke FROM half_levels GROUP BY ALL),
fcol AS (SELECT iy, ix, list(clc ORDER BY level) AS clc_l, list(qc ORDER BY level) AS qc_l, list(qi ORDER BY level) AS qi_l, list(qv ORDER BY level) AS qv_l, list(t ORDER BY level) AS t_l, list(p ORDER BY level) AS p_l FROM full_levels GROUP BY ALL)"""

_EDGE = lambda a, i, n: f"{a}[least(greatest({i}, 0), {n - 1}) + 1]"


def _nodes_sql(heights: list[str], values: list[str], at: str, source: str) -> str:
    zs = ", ".join(f"{h} AS z{i}" for i, h in enumerate(heights))
    vs = ", ".join(f"{v} AS v{i}" for i, v in enumerate(values))
    return f"nodes AS (SELECT *, {zs}, {vs}, {at} AS z FROM {source}),{PCHIP_SQL}"


_TKE = f"""WITH {COLUMNS_SQL}, {SAMPLES_SQL}, {_STENCIL},
j AS (SELECT *, least(coalesce(len(list_filter(hhl, lambda h: h >= height)), 0), 10) - 1 AS k0 FROM near JOIN hcol USING (iy, ix)),
i AS (SELECT *, greatest(least(k0, 9), 0) AS kk FROM j),
{_nodes_sql([_EDGE('hhl', f'kk + {d}', 11) for d in (-1, 0, 1, 2)], [_EDGE('tke', f'kk + {d}', 11) for d in (-1, 0, 1, 2)], 'greatest(height, hhl[11])', 'i')}
SELECT k, greatest(CASE WHEN sum(w) FILTER (height < hhl[1]) > 1e-5 THEN sum(value * w) FILTER (height < hhl[1]) / sum(w) FILTER (height < hhl[1]) ELSE 0 END, 0.0) AS tke FROM done GROUP BY k"""


@query("sample_turbulence", "k:i tke:d", _TKE)
def sample_turbulence(spark, sf):
    return sample.sample_turbulence(samples(spark, sf), columns(spark, sf, ("hhl", "tke")), *shape(spark, sf), ["k"])


@query("ground_height", "k:i ground:d", f"WITH {COLUMNS_SQL}, {SAMPLES_SQL}, {_STENCIL} SELECT k, sum(w * hhl[11]) AS ground FROM near JOIN hcol USING (iy, ix) GROUP BY k")
def ground_height(spark, sf):
    return sample.ground_height(samples(spark, sf), columns(spark, sf, ("hhl",)), *shape(spark, sf), ["k"])


_MATERIAL_ONE = lambda f: f"""WITH {COLUMNS_SQL}, {SAMPLES_SQL}, {_STENCIL},
j AS (SELECT *, greatest(len(list_filter([(hhl[g] + hhl[g + 1]) / 2 FOR g IN range(1, 11)], lambda c: c >= height)) - 1, 0) AS kk FROM near JOIN hcol USING (iy, ix) JOIN fcol USING (iy, ix)),
{_nodes_sql([f"({_EDGE('hhl', f'kk + {d}', 11)} + {_EDGE('hhl', f'kk + {d + 1}', 11)}) / 2" for d in (-1, 0, 1, 2)], [_EDGE(f + '_l', f'kk + {d}', 10) for d in (-1, 0, 1, 2)], 'height', 'j')}
SELECT k, CASE WHEN any_value(src_x) > 11 OR any_value(src_y) > (SELECT max(iy) FROM half_levels) THEN 0 WHEN sum(w) FILTER (height < hhl[1] AND height >= hhl[11]) > 1e-5 THEN sum(value * w) FILTER (height < hhl[1] AND height >= hhl[11]) / sum(w) FILTER (height < hhl[1] AND height >= hhl[11]) ELSE 0 END AS v FROM done GROUP BY k"""  # noqa: E731


@query("sample_material", "k:i t:d", f"SELECT k, v AS t FROM ({_MATERIAL_ONE('t')})")
def sample_material(spark, sf):
    return sample.sample_material(samples(spark, sf), columns(spark, sf), *shape(spark, sf), ["k"])


@query("sample_cover", "k:i clc:d", f"SELECT k, least(greatest(v, 0.0), 1.0) AS clc FROM ({_MATERIAL_ONE('clc')})")
def sample_cover(spark, sf):
    return sample.sample_material(samples(spark, sf), columns(spark, sf), *shape(spark, sf), ["k"])


@query("synthesise_plain", "k:i density:d")
def synthesise_plain(spark, sf):
    """No SQL: tests compare it with plain arithmetic, point by point."""
    return sample.synthesise_plain(samples(spark, sf), columns(spark, sf), *shape(spark, sf), ["k"])


@query("synthesise", "k:i density:d")
def synthesise(spark, sf):
    """No SQL: as `synthesise_plain`, with displacement and density factor."""
    k = F.col("k")
    at = samples(spark, sf).select("*", (k * 211.0).alias("world_x"), (k * 97.0).alias("world_y"), F.lit(1 / 2000.0).alias("to_src_x"), F.lit(1 / 2000.0).alias("to_src_y"))
    return sample.synthesise(at, columns(spark, sf), *shape(spark, sf), ["k"])


_RISING = SAMPLES_SQL.replace("samples AS", "places AS", 1) + ", samples AS (SELECT k * 4 + z AS k, src_x, src_y, height * (z + 1) / 4 AS height FROM places, range(4) u(z))"
_OLDER = f"""WITH {COLUMNS_SQL}, {_RISING}, {_STENCIL},
j0 AS (SELECT *, greatest(len(list_filter([(hhl[g] + hhl[g + 1]) / 2 FOR g IN range(1, 11)], lambda c: c >= height)) - 1, 0) AS k0, [((2 * iy + ix + l) % 7) * 0.5 - 0.5 FOR l IN range(11)] AS w_l FROM near JOIN hcol USING (iy, ix) JOIN fcol USING (iy, ix)),"""
_OLDER_END = "coalesce(sum(value * w) FILTER (height < hhl[1] AND height > hhl[11]), 0) AS v FROM done GROUP BY k"
_OLDER_T = f"""{_OLDER} j AS (SELECT *, k0 AS kk FROM j0),
{_nodes_sql([f"({_EDGE('hhl', f'kk + {d}', 11)} + {_EDGE('hhl', f'kk + {d + 1}', 11)}) / 2" for d in (-1, 0, 1, 2)], [_EDGE('t_l', f'kk + {d}', 10) for d in (-1, 0, 1, 2)], 'height', 'j')}
SELECT k, {_OLDER_END}"""
_OLDER_W = f"""{_OLDER} j AS (SELECT *, k0 + CASE WHEN height >= {_EDGE('hhl', 'k0 + 1', 11)} THEN 0 ELSE 1 END AS kk FROM j0),
{_nodes_sql([_EDGE('hhl', f'kk + {d}', 11) for d in (-1, 0, 1, 2)], [_EDGE('w_l', f'kk + {d}', 11) for d in (-1, 0, 1, 2)], 'height', 'j')}
SELECT k, {_OLDER_END}"""


def _rising(spark, sf):
    """Target columns of four heights each."""
    h, k = F.col("height"), F.col("k")
    return samples(spark, sf).select("k", "src_x", "src_y", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: h * i / 4).alias("heights"), (k * 211.0).alias("world_x"), (k * 97.0).alias("world_y"))


@query("sample_older", "k:i z:i t:d w:d", f"SELECT k // 4 AS k, k % 4 AS z, t.v AS t, w.v AS w FROM ({_OLDER_T}) t JOIN ({_OLDER_W}) w USING (k)")
def sample_older(spark, sf):
    return sample.sample_older(_rising(spark, sf), wind_columns(spark, sf), *shape(spark, sf), ["k"])


@query("synthesise_shear", "k:i z:i density:d")
def synthesise_shear(spark, sf):
    """No SQL, for the noise at many scales; tests compare it with plain arithmetic, voxel by voxel."""
    return sample.synthesise_shear(_rising(spark, sf), wind_columns(spark, sf), *shape(spark, sf), ["k"])


_SLICE = f"WITH {COLUMNS_SQL}, h AS (SELECT iy, ix, level, hhl, lead(hhl) OVER (PARTITION BY iy, ix ORDER BY level) AS low FROM half_levels)"


@query("slice_at_altitude", "iy:i ix:i value:d", f"{_SLICE} SELECT iy, ix, min_by(t, level) FILTER (low <= 3000 AND 3000 <= hhl) AS value FROM h JOIN full_levels USING (iy, ix, level) GROUP BY ALL")
def slice_at_altitude(spark, sf):
    c = columns(spark, sf).select("iy", "ix", "hhl", F.col("t").alias("values"))
    return sample.slice_at_altitude(c, 3000.0)


@query("slice_half_levels", "iy:i ix:i value:d", f"{_SLICE} SELECT iy, ix, min_by(tke, (abs(hhl - 3000), level)) AS value FROM half_levels GROUP BY ALL")
def slice_half_levels(spark, sf):
    return sample.slice_at_altitude(columns(spark, sf).select("iy", "ix", "hhl", F.col("tke").alias("values")), 3000.0, True)


_XY = f"WITH {POINTS_SQL}, g AS (SELECT k, CAST(k // 40 AS INT) AS iy, CAST(k % 40 AS INT) AS ix, lat, lon FROM points)"


@query("region_indices", "iy0:i iy1:i ix0:i ix1:i", f"{_XY} SELECT min(iy) AS iy0, max(iy) AS iy1, min(ix) AS ix0, max(ix) AS ix1 FROM g WHERE lat BETWEEN 46.5 AND 47.5 AND lon BETWEEN 10.0 AND 12.0")
def region_indices(spark, sf):
    g = points(spark, sf).select(F.floor(F.col("k") / 40).cast("int").alias("iy"), (F.col("k") % 40).cast("int").alias("ix"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return sample.region_indices(g, 46.5, 47.5, 10.0, 12.0)


@query("region_points", "k:i lat:d lon:d", f"WITH {POINTS_SQL} SELECT * FROM points WHERE lat BETWEEN 46.5 AND 47.5 AND lon BETWEEN 10.0 AND 12.0")
def region_points(spark, sf):
    return sample.region(points(spark, sf), 46.5, 47.5, 10.0, 12.0)


@query("axis_figures", "least:d most:d n:i", f"WITH {POINTS_SQL} SELECT min(lat) AS least, max(lat) AS most, count(*) AS n FROM points")
def axis_figures(spark, sf):
    return sample.axis_figures(points(spark, sf), "lat")


# --- sources in DataFrame form -------------------------------------------------------------------

_FIELDS = "WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'run/clct.grib2' WHEN 1 THEN 'run/qc_' || (p_partkey % 9 + 1) || '.grib2' ELSE 'run/t_' || (p_partkey % 9 + 1) || '.grib2' END AS file, p_partkey % 5 AS iy, p_partkey % 7 AS ix, p_retailprice AS value FROM part)"


def _fields(spark, sf):
    c = F.col("p_partkey")
    name = F.when(c % 4 == 0, "run/clct.grib2").when(c % 4 == 1, F.concat(F.lit("run/qc_"), c % 9 + 1, F.lit(".grib2"))).otherwise(F.concat(F.lit("run/t_"), c % 9 + 1, F.lit(".grib2")))
    return table(spark, sf, "part").select(name.alias("file"), (c % 5).alias("iy"), (c % 7).alias("ix"), F.col("p_retailprice").alias("value"))


@query("cube_stack", "var:s level:i n:i total:d", f"{_FIELDS} SELECT regexp_extract(file, 'run/([a-z]+)_', 1) AS var, CAST(regexp_extract(file, '_(\\d+)\\.', 1) AS INT) AS level, count(*) AS n, sum(CAST(value AS FLOAT)::DOUBLE) AS total FROM f WHERE file <> 'run/clct.grib2' GROUP BY ALL")
def cube_stack(spark, sf):
    from ..sources import cube

    return cube.stacked(_fields(spark, sf)).groupBy("var", "level").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total"))


@query("file_map", "var:s levels:s", f"{_FIELDS} SELECT var, string_agg(level, ',' ORDER BY level) AS levels FROM (SELECT DISTINCT regexp_extract(file, 'run/([a-z]+)_', 1) AS var, regexp_extract(file, '_(\\d+)\\.', 1) AS level FROM f WHERE file <> 'run/clct.grib2') GROUP BY var")
def file_map(spark, sf):
    from ..sources import cube

    files = _fields(spark, sf).select("file").distinct()
    return cube.levels_by_variable(files).select("var", F.array_join(F.map_keys("files").cast("array<string>"), ",").alias("levels"))


_INVENTORY = "SELECT p_brand AS short_name, count(*) AS n, min(p_size) AS least, max(p_size) AS most, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS levels FROM part GROUP BY p_brand"


@query("message_inventory_all", "short_name:s n:i least:i most:i levels:s", _INVENTORY)
@query("message_inventory", "short_name:s n:i least:i most:i levels:s", _INVENTORY)
def message_inventory(spark, sf):
    """The inventory of every row of part."""
    m = table(spark, sf, "part").select(F.col("p_brand").alias("short_name"), F.lit("hybrid").alias("type_of_level"), F.col("p_size").alias("level"))
    return stats.messages_by_variable(m).withColumn("levels", F.array_join(F.array_sort(F.col("levels").cast("array<string>")), ","))


_VARS = ", ".join(f"('{n}', '{k}', {len(v) if v else 1}, {str(v is not None).lower()})" for n, k, v, _ in VARIABLES)


@query("variable_catalog", "level_type:s variables:i files:i", f"SELECT t AS level_type, count(*) AS variables, sum(n) AS files FROM (VALUES {_VARS}) v(name, t, n, has) GROUP BY t")
def variable_catalog(spark, sf):
    v = variables(spark)
    return v.groupBy("level_type").agg(F.count("*").alias("variables"), F.sum(F.size("levels")).alias("files"))


# --- statistics -------------------------------------------------------------------------------------

_ERR = f"""{V}, r AS (SELECT tx, ty, density, round_even(least(density, 32.0) / 32 * 7, 0) / 7 * 32 AS rebuilt FROM voxels), e AS (SELECT *, abs(rebuilt - density) AS e FROM r),
f AS (SELECT tx, ty, max(e) AS max_abs, avg(e) AS mean_abs, quantile_cont(e, 0.5) AS median_abs, quantile_cont(e, 0.99) AS p99_abs, quantile_cont(e, 0.999) AS p999_abs, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse,
  avg(CASE WHEN density > 32 THEN 1.0 ELSE 0 END) AS clipped_fraction, avg(CASE WHEN rebuilt = 0 AND density > 0 THEN 1.0 ELSE 0 END) AS zero_loss_fraction, quantile_cont(density, 0.999) AS p99 FROM e GROUP BY ALL)"""
_FIGURES = "max_abs:d mean_abs:d median_abs:d p99_abs:d p999_abs:d mse:d rmse:d clipped_fraction:d zero_loss_fraction:d p99:d"


def _errors(spark, sf):
    v = voxels(spark, sf).withColumn("rebuilt", F.rint(F.least("density", F.lit(32.0)) / 32 * 7) / 7 * 32)
    return stats.error_figures(v, ["tx", "ty"])


@query("error_stats", f"tx:i ty:i {_FIGURES}", f"{_ERR} SELECT * FROM f")
def error_stats(spark, sf):
    return _errors(spark, sf)


@query("error_summary", "tiles:i max_abs:d median_abs:d p99_abs:d trimmed_max_abs:d rmse:d mse:d clipped_fraction:d zero_loss_fraction:d recommended:d fraction_above_limit:d", f"{_ERR} SELECT count(*) AS tiles, max(max_abs) AS max_abs, quantile_cont(median_abs, 0.5) AS median_abs, quantile_cont(p99_abs, 0.5) AS p99_abs, quantile_cont(max_abs, 0.999) AS trimmed_max_abs, avg(rmse) AS rmse, avg(mse) AS mse, avg(clipped_fraction) AS clipped_fraction, avg(zero_loss_fraction) AS zero_loss_fraction, quantile_cont(p99, 0.5) AS recommended, avg(CASE WHEN p99 > 32 THEN 1.0 ELSE 0 END) AS fraction_above_limit FROM f")
def error_summary(spark, sf):
    return stats.error_summary(_errors(spark, sf))


@query("top_tiles", "tx:i ty:i p99:d", f"{_ERR} SELECT tx, ty, p99 FROM f ORDER BY p99 DESC, tx, ty LIMIT 5")
def top_tiles(spark, sf):
    return stats.worst_tiles(_errors(spark, sf))


@query("voxel_stats", "n:i least:d most:d mean:d variance:d nonzero:i near_max:i near_percent:d", f"{V} SELECT count(*) AS n, min(density) AS least, max(density) AS most, avg(density) AS mean, sum(density * density) / count(*) - avg(density) ** 2 AS variance, count(*) FILTER (density <> 0) AS nonzero, count(*) FILTER (density >= 3.0) AS near_max, 100.0 * count(*) FILTER (density >= 3.0) / count(*) AS near_percent FROM voxels")
def voxel_stats(spark, sf):
    return stats.merged(stats.voxel_partials(voxels(spark, sf), ["tx", "ty"], 3.0))


@query("canvas_stats", "least:d most:d mean:d variance:d nonzero:i nonzero_median:d", f"{G}, {_CANVAS} SELECT min(value) AS least, max(value) AS most, avg(value) AS mean, var_pop(value) AS variance, count(*) FILTER (value > 0) AS nonzero, quantile_cont(value, 0.5) FILTER (value > 0) AS nonzero_median FROM canvas")
def canvas_stats(spark, sf):
    return stats.canvas_figures(_canvas(spark, sf))


@query("percentiles", "n:i p50:d p90:d p95:d p98:d p99:d most:d suggested:d", f"WITH {CELLS_SQL}, b AS (SELECT 140 * pow(qc / greatest(clc, 0.01) * 1000, 0.7) AS b FROM cells WHERE clc * 100 > 1.0 AND qc > 1e-6) SELECT count(*) AS n, quantile_cont(b, 0.5) AS p50, quantile_cont(b, 0.9) AS p90, quantile_cont(b, 0.95) AS p95, quantile_cont(b, 0.98) AS p98, quantile_cont(b, 0.99) AS p99, max(b) AS most, least(greatest(quantile_cont(b, 0.98), 40), 80) AS suggested FROM b")
def percentiles(spark, sf):
    return stats.density_percentiles(cells(spark, sf).select((F.col("clc") * 100).alias("clc"), "qc"))


@query("exported_layer", "tx:i py:i px:i grey:i", f"{G}, {_CANVAS} SELECT tx, py, px, floor(least(greatest(sqrt(greatest(value, 0)) / (SELECT sqrt(max(value)) FROM canvas), 0), 1) * 255) AS grey FROM canvas")
def exported_layer(spark, sf):
    return stats.exported_layer(_canvas(spark, sf))


_MOSAIC = f"""WITH {VOXELS_SQL}, raw AS (SELECT ty * 16 + vy AS py, tx * 16 + vx AS px, sum(density) AS value FROM voxels GROUP BY ALL),
px0 AS (SELECT py, px, CAST(floor(least(greatest(sqrt(greatest(value, 0)) / (SELECT sqrt(max(value)) FROM raw), 0), 1) * 255) AS INT) AS grey FROM raw),
wide AS (SELECT (max(p_partkey) // 64 + 1) * 16 AS w FROM part),
px1 AS (SELECT y AS py, x AS px, coalesce(grey, 0) AS grey FROM range(64) a(y), (SELECT unnest(range(w)) AS x FROM wide) b LEFT JOIN px0 ON py = y AND px = x)"""


def _lanczos_sql(source: str, axis: str, other: str, outs: str) -> str:
    d = f"(({axis} + 0.5::DOUBLE) / (64::DOUBLE / 24) - o - 0.5::DOUBLE) * pi()"
    return f"""SELECT {other}, o AS {axis}, CAST(least(greatest(floor(round(sum(grey * w) / sum(w), 6) + 0.5), 0), 255) AS INT) AS grey
  FROM (SELECT {other}, o, grey, CASE WHEN d = 0 THEN 1.0 ELSE sin(d) * sin(d / 3) * 3 / d / d END AS w FROM (SELECT {other}, o, grey, {d} AS d FROM {source}, {outs} r(o)) WHERE abs(d) < 3 * pi()) GROUP BY ALL"""


@query("shrunk_layer", "py:i px:i grey:i", f"{_MOSAIC}, px2 AS ({_lanczos_sql('px1', 'px', 'py', '(SELECT unnest(range(w * 3 // 8)) FROM wide)')}) {_lanczos_sql('px2', 'py', 'px', 'range(24)')}")
def shrunk_layer(spark, sf):
    """The mosaic of all tiles as an 8-bit picture, 64 high and as wide as there are tiles, shrunk to three eighths."""
    wide = (table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] // PARTS + 1) * PIXELS
    at = [(F.col("ty") * PIXELS + F.col("vy")).alias("py"), (F.col("tx") * PIXELS + F.col("vx")).alias("px")]
    grey = stats.exported_layer(voxels(spark, sf).groupBy(*at).agg(F.sum("density").alias("value")))
    every = spark.range(64 * wide).select(F.floor(F.col("id") / wide).cast("int").alias("py"), (F.col("id") % wide).cast("int").alias("px"))
    whole = every.join(grey, ["py", "px"], "left").select("py", "px", F.coalesce("grey", F.lit(0)).alias("grey"))
    return stats.shrunk(whole, 64, wide, wide * 3 // 8)


_KINDS = "['surface', 'heightAboveGround', 'atmosphere', 'isobaricInhPa', 'nominalTop', 'generalVertical']"


@query("message_structure", "type_of_level:s n:i variables:s", f"SELECT t AS type_of_level, count(*) AS n, string_agg(v || ':' || c, ',' ORDER BY v) AS variables FROM (SELECT {_KINDS}[p_partkey % 6 + 1] AS t, p_brand AS v, count(DISTINCT p_size) AS c FROM part GROUP BY ALL) WHERE t <> 'generalVertical' GROUP BY t")
def message_structure(spark, sf):
    kinds = F.array(*[F.lit(k) for k in (*stats.LEVEL_TYPES, "generalVertical")])
    m = table(spark, sf, "part").select(F.col("p_brand").alias("short_name"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("type_of_level"), F.col("p_size").alias("level"))
    shapes = F.transform("variables", lambda s: F.concat(s["short_name"], F.lit(":"), s["n_levels"]))
    return stats.structure(m).withColumn("variables", F.array_join(shapes, ","))


@query("every_voxel", "tx:i ty:i vz:i vy:i vx:i density:d", f"WITH {VOXELS_SQL} SELECT t.tx, t.ty, CAST(i // 256 AS INT) AS vz, CAST((i // 16) % 16 AS INT) AS vy, CAST(i % 16 AS INT) AS vx, coalesce(v.density, 0) AS density FROM (SELECT DISTINCT tx, ty FROM voxels) t, range(2048) r(i) LEFT JOIN voxels v ON v.tx = t.tx AND v.ty = t.ty AND v.vz = i // 256 AND v.vy = (i // 16) % 16 AND v.vx = i % 16")
def every_voxel(spark, sf):
    v = voxels(spark, sf)
    dense = volume.every_voxel(v.select("tx", "ty").distinct(), LEVELS, PIXELS, PIXELS)
    return dense.join(v, ["tx", "ty", "vz", "vy", "vx"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


# --- codecs ---------------------------------------------------------------------------------------------

_PLAIN_BLOCKS = f"""{G}, px AS (SELECT vz, vy // 4 AS "by", vx // 4 AS bx, (vy % 4) * 4 + vx % 4 AS i, least(greatest(density / 32.0, 0.0), 1.0) AS v FROM grid),
ext AS (SELECT vz, "by", bx, least(min(v), 1.0) AS lo, greatest(max(v), 0.0) AS hi, max(v) AS top FROM px GROUP BY ALL),
cand AS (SELECT vz, "by", bx, top, c, least(greatest(lo + 0.004 * d, 0.0), 1.0) AS lo, least(greatest(hi + 0.004 * u, 0.0), 1.0) AS hi FROM ext, (VALUES (0, 0, 0), (1, 1, -1), (2, 1, 0), (3, 0, -1), (4, -1, 1)) o(c, d, u)),
fixed AS (SELECT vz, "by", bx, top, c, lo, CASE WHEN lo >= hi THEN lo + 0.0001 ELSE hi END AS hi FROM cand),
idx AS (SELECT f.*, p.v, 7 - CAST(round_even(least(greatest((p.v - lo) / (hi - lo), 0.0), 1.0) * 7, 0) AS INT) AS a FROM fixed f JOIN px p USING (vz, "by", bx)),
err AS (SELECT vz, "by", bx, c, any_value(top) AS top, any_value(lo) AS lo, any_value(hi) AS hi, sum((v - CASE WHEN a = 0 THEN hi WHEN a = 7 THEN lo ELSE lo + (hi - lo) * ((8 - (a + 1)) / 7.0) END) ** 2) AS e FROM idx GROUP BY vz, "by", bx, c),
best AS (SELECT * FROM err QUALIFY row_number() OVER (PARTITION BY vz, "by", bx ORDER BY round(e, 12), c) = 1),
q0 AS (SELECT vz, "by", bx, top, CAST(round_even(hi * 255, 0) AS INT) AS h, CAST(round_even(lo * 255, 0) AS INT) AS l FROM best),
q AS (SELECT vz, "by", bx, CASE WHEN top > 0 AND h = 0 THEN 1 ELSE h END AS r0, CASE WHEN top > 0 AND h = 0 THEN 0 ELSE l END AS r1 FROM q0)"""


def _keyed(sql: str, keys: str) -> str:
    """BC4 steps with more keys of a block."""
    return sql.replace('vz, "by", bx', f'{keys}, vz, "by", bx').replace('SELECT vz, vy // 4 AS "by"', f'SELECT {keys}, vz, vy // 4 AS "by"')


_BLOCKS = _keyed(_PLAIN_BLOCKS, "tx")


def _blocks(spark, sf):
    return bc4.encode_volume(grid(spark, sf), PIXELS, PIXELS, [*TX, "vz"])


@query("bc4_blocks", "tx:i vz:i by:i bx:i n:i total:d", f"{G_ODD} SELECT tx, vz, vy // 4 AS \"by\", vx // 4 AS bx, 16 AS n, sum(CASE WHEN vx = 12 THEN 4 ELSE 1 END * CASE WHEN vy = 14 THEN 2 ELSE 1 END * density) AS total FROM grid GROUP BY ALL")
def bc4_blocks(spark, sf):
    return bc4.blocks(grid(spark, sf, *ODD), *ODD[1:], [*TX, "vz"]).select("tx", "vz", "by", "bx", F.size("pixels").alias("n"), F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("bc4_endpoints", "tx:i vz:i by:i bx:i r0:i r1:i", f"{_BLOCKS} SELECT tx, vz, \"by\", bx, r0, r1 FROM q")
def bc4_endpoints(spark, sf):
    ends = _blocks(spark, sf).withColumn("e", bc4.from_bytes("content"))
    return ends.select("tx", "vz", "by", "bx", "e.r0", "e.r1")


_PLAIN_INDEX = f"""{_PLAIN_BLOCKS}, ix AS (SELECT vz, "by", bx, i, v, r0, r1, CASE WHEN r0 <= r1 THEN 0 ELSE CAST(7 - round_even(least(greatest((v - r1 / 255.0) / (r0 / 255.0 - r1 / 255.0), 0.0), 1.0) * 7, 0) AS INT) END AS a FROM px JOIN q USING (vz, "by", bx)),
im AS (SELECT *, CASE WHEN r0 <= r1 OR a = 0 THEN 0 WHEN a = 7 THEN CASE WHEN v > 0 AND r1 = 0 THEN 7 ELSE 1 END ELSE a + 1 END AS x FROM ix)"""
_INDEX = _keyed(_PLAIN_INDEX, "tx")


@query("bc4_encode", "tx:i vz:i by:i bx:i bits:i", f"{_INDEX} SELECT tx, vz, \"by\", bx, sum(CAST(x AS BIGINT) << (3 * i)) AS bits FROM im GROUP BY ALL")
def bc4_encode(spark, sf):
    packed = _blocks(spark, sf)
    return packed.select("tx", "vz", "by", "bx", bc4.from_bytes("content")["bits"].alias("bits"))


@query("bc4_decode", "tx:i vz:i by:i bx:i i:i v:d", f"{_INDEX} SELECT tx, vz, \"by\", bx, i, CASE WHEN r0 > r1 THEN CASE x WHEN 0 THEN r0 / 255.0 WHEN 1 THEN r1 / 255.0 ELSE r1 / 255.0 + (r0 - r1) / 255.0 * (8 - x) / 7.0 END ELSE r0 / 255.0 END AS v FROM im")
def bc4_decode(spark, sf):
    return _blocks(spark, sf).select("tx", "vz", "by", "bx", F.posexplode(bc4.texels_of("content")).alias("i", "v"))


@query("bc4_volume", "tx:i vz:i vy:i vx:i v:d", f"{_INDEX} SELECT tx, vz, \"by\" * 4 + i // 4 AS vy, bx * 4 + i % 4 AS vx, CASE WHEN r0 > r1 THEN CASE x WHEN 0 THEN r0 / 255.0 WHEN 1 THEN r1 / 255.0 ELSE r1 / 255.0 + (r0 - r1) / 255.0 * (8 - x) / 7.0 END ELSE r0 / 255.0 END AS v FROM im")
def bc4_volume(spark, sf):
    """Whole volumes to encoded blocks and back to texels."""
    packed = bc4.encode_volume(grid(spark, sf), PIXELS, PIXELS, [*TX, "vz"])
    return bc4.decode_volume(packed, PIXELS, PIXELS, [*TX, "vz"]).withColumnRenamed("value", "v")


_HALF = """half AS (SELECT tx, ty, vz, vy, vx, CASE WHEN density = 0 THEN 0 ELSE round_even(density / u, 0) * u END AS density FROM (SELECT *, greatest(pow(2.0, floor(log2(nullif(density, 0))) - 10), pow(2.0, -24)) AS u FROM voxels))"""


@query("raw_tile_roundtrip", "tx:i ty:i i:i density:d zoom:i", f"{V}, {_HALF} SELECT tx, ty, (vz * 16 + vy) * 16 + vx AS i, density, 10 AS zoom FROM half WHERE density > 0")
def raw_tile_roundtrip(spark, sf):
    """Raw tiles made and read again: half floats behind a JSON header in a zstd stream."""

    def again(names, values):
        out = [raw_tiles.decode(raw_tiles.encode(dict.fromkeys(raw_tiles.FIELDS, 1.0) | {"tile_z": z}, v)) for (z, _, _), v in zip(names.tolist(), values, strict=True)]
        density = np.concatenate([v for _, v in out]).astype(np.float64)
        size = len(density) // len(out)
        row = np.repeat(np.arange(len(out)), size)
        places = [pa.array(names[row, c], pa.int32()) for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([*places, pa.array(np.array([h["tile_z"] for h, _ in out])[row], pa.int32()), pa.array(np.tile(np.arange(size), len(out)), pa.int32()), pa.array(density)], ["tx", "ty", "zoom", "i", "density"])

    return lod.by_tile(voxels(spark, sf), LEVELS, PIXELS, again, "tx int, ty int, zoom int, i int, density double").filter("density > 0")


@query("ktx2_roundtrip", "tx:i ty:i format:s levels:i scheme:i depth:i res:s total:d", f"{V}, {_HALF} SELECT tx, ty, 'R16_SFLOAT' AS format, 1 AS levels, 2 AS scheme, 8 AS depth, '218.75' AS res, sum(density) AS total FROM half GROUP BY ALL")
def ktx2_roundtrip(spark, sf):
    """Containers of half-float tiles made and read again."""
    ship(spark)

    def halves(names, values):
        mips = pa.array([[v.tobytes()] for v in values.astype("<f2")], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([*[pa.array(names[:, i], pa.int32()) for i in (1, 2)], mips], ["tx", "ty", "mips"])

    @F.pandas_udf("format string, levels int, scheme int, depth int, res string, total double")
    def again(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            head, levels, pairs = ktx2.decode(bytes(c))
            rows.append((head["format"], head["levels"], head["scheme"], head["depth"], pairs["phys_res_z"], float(np.frombuffer(levels[0], "<f2").astype(np.float64).sum())))
        return pd.DataFrame(rows, columns=["format", "levels", "scheme", "depth", "res", "total"])

    tiles = lod.by_tile(voxels(spark, sf), LEVELS, PIXELS, halves, "tx int, ty int, mips array<binary>").withColumn("metadata", F.create_map(F.lit("phys_res_z"), F.lit("218.75")))
    return ktx2.containers(tiles, "R16_SFLOAT", PIXELS, PIXELS, LEVELS).select("tx", "ty", again("content").alias("c")).select("tx", "ty", "c.*")


@query("raw_tile_files", "tx:i ty:i vz:i vy:i vx:i density:d", f"{V}, {_HALF} SELECT tx, ty, vz, vy, vx, density FROM half WHERE density > 0")
def raw_tile_files(spark, sf):
    """Raw tiles written as files and read again."""
    at = scratch(spark, "tiles")
    sinks.raw_tile_files(voxels(spark, sf), at, LEVELS, PIXELS, (1.0, 1.0, 1.0)).write.format("noop").mode("overwrite").save()
    return raw_tiles.voxels(raw_tiles.read(spark, at), PIXELS, PIXELS).filter("density > 0")


def _mips_sql() -> str:
    """All mips of all tiles of the pyramid as texels, lines from the south, absent ones 0."""
    sizes = volume.mip_sizes(LEVELS, PIXELS, PIXELS)
    out = [f"t AS (SELECT zoom, tx, ty, vz, vy, vx, density FROM voxels UNION ALL {_TREE})", "m0 AS (SELECT zoom, tx, ty, vz, 15 - vy AS vy, vx, density FROM t)"]
    out += [f"m{k} AS (SELECT zoom, tx, ty, vz // 2 AS vz, vy // 2 AS vy, vx // 2 AS vx, sum(density) / 8 AS density FROM m{k - 1} GROUP BY ALL)" for k in range(1, len(sizes))]
    dense = " UNION ALL ".join(
        f"SELECT a.zoom, a.tx, a.ty, {k} AS level, a.vz, a.vy, a.vx, coalesce(m.density, 0) AS density FROM (SELECT zoom, tx, ty, CAST(i // {y * x} AS INT) AS vz, CAST(i // {x} % {y} AS INT) AS vy, CAST(i % {x} AS INT) AS vx FROM (SELECT DISTINCT zoom, tx, ty FROM t), range({z * y * x}) r(i)) a LEFT JOIN m{k} m USING (zoom, tx, ty, vz, vy, vx)"
        for k, (z, y, x) in enumerate(sizes)
    )
    return f"{V}, {', '.join(out)}, texels AS ({dense})"


def _coded_sql(keys: str) -> str:
    """The BC4 steps of `_BLOCKS` and `_INDEX` over `texels` with more keys, up to the decoded value of each texel."""
    return _keyed("px AS" + _PLAIN_INDEX.split(", px AS", 1)[1].replace("FROM grid", "FROM texels"), keys)


_LOD_KEYS = "zoom, tx, ty, level"


@query(
    "lod_tile_files", "zoom:i x:i row:i level:i vz:i vy:i vx:i v:d res:s scale:s codec:s tile:s",
    f"""{_mips_sql()}, {_coded_sql(_LOD_KEYS)} SELECT zoom, tx AS x, CAST(pow(2, zoom) AS INT) - 1 - ty AS row, level, vz, "by" * 4 + i // 4 AS vy, bx * 4 + i % 4 AS vx,
CASE WHEN r0 > r1 THEN CASE x WHEN 0 THEN r0 / 255.0 WHEN 1 THEN r1 / 255.0 ELSE r1 / 255.0 + (r0 - r1) / 255.0 * (8 - x) / 7.0 END ELSE r0 / 255.0 END AS v,
CASE zoom WHEN 10 THEN '2.5' WHEN 9 THEN '5.0' ELSE '10.0' END AS res, '32.0' AS scale, 'BC4' AS codec, zoom || '/' || tx || '/' || (CAST(pow(2, zoom) AS INT) - 1 - ty) AS tile FROM im""",
)
def lod_tile_files(spark, sf):
    """Tiles of a pyramid committed as containers of BC4 mips, and every texel of every mip read again."""
    at = scratch(spark, "lod")
    sinks.lod_tile_files(volume.pyramid(voxels(spark, sf), ZOOM - 2, ZOOM, PIXELS), at, LEVELS, PIXELS, (2.5, 2.5, 218.75), ZOOM)
    part = lambda i: F.element_at(F.split(F.regexp_replace("path", r"\.ktx2$", ""), "/"), i).cast("int")
    m = F.col("metadata")
    place = F.concat_ws("/", m["tile_z"], m["tile_x"], m["tile_y"])
    tiles = ktx2.read(spark, at).filter("format = 'BC4_UNORM_BLOCK' AND scheme = 2").select(part(-3).alias("zoom"), part(-2).alias("x"), part(-1).alias("row"), m["phys_res_x"].alias("res"), m["val_scale"].alias("scale"), m["compression"].alias("codec"), place.alias("tile"), "mips")
    return lod.texels(tiles, LEVELS, PIXELS).withColumnRenamed("value", "v")


#: A region that cuts into the tiles at the top left of the map and reaches beyond them; its pixels by plain arithmetic.
_REGION = (-179.8, 84.9, -178.1, 85.03)


def _region_pixels() -> tuple[int, int, int, int, int, int]:
    """x0, x1, y0, y1 of the region, and width and height of its canvas."""
    west, south, east, north = _REGION
    px = lambda lon: (lon + 180) / 360 * 1024 * 16
    py = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 1024 * 16
    return math.floor(px(west)), math.ceil(px(east)), math.floor(py(north)), math.ceil(py(south)), (math.floor(px(east) / 16) + 1) * 16, (math.floor(py(south) / 16) + 1) * 16


_X0, _X1, _Y0, _Y1, _WIDE, _HIGH = _region_pixels()
_HALF_OF = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} / greatest(pow(2.0, floor(log2(nullif({0}, 0))) - 10), pow(2.0, -24)), 0) * greatest(pow(2.0, floor(log2(nullif({0}, 0))) - 10), pow(2.0, -24)) END"


@query(
    "shadow_map_file", "px:i py:i shadow:d",
    f"""{_shadow_sql('vz')}, tiles AS (SELECT DISTINCT tx, ty FROM voxels), e AS (SELECT tx, ty, vy, vx, exp(4.0 * height) AS e FROM h),
canvas AS (SELECT CAST(x AS INT) AS px, CAST(y AS INT) AS py, CASE WHEN t.tx IS NULL THEN 0.0 WHEN e.e IS NULL THEN 1.0 ELSE {_HALF_OF.format('e.e')} END AS value FROM range({_WIDE}) a(x), range({_HIGH}) b(y) LEFT JOIN tiles t ON t.tx = x // 16 AND t.ty = y // 16 LEFT JOIN e ON e.tx = x // 16 AND e.ty = y // 16 AND e.vx = x % 16 AND e.vy = y % 16),
{_gauss_sql('canvas', 'py', 'px', _HIGH, 'gy')}, {_gauss_sql('gy', 'px', 'py', _WIDE, 'gx')} SELECT px, py, {_HALF_OF.format('value')} AS shadow FROM gx WHERE px >= {_X0} AND px < {_X1} AND py >= {_Y0} AND py < {_Y1}""",
)
def shadow_map_file(spark, sf):
    """The shadow map of a region, blurred, cut and written in bands as one container, and read again."""
    at = scratch(spark, "shadow")
    sinks.shadow_map_file(voxels(spark, sf), at, "shadow.ktx2", LEVELS, PIXELS, ZOOM, _REGION, band_pixels=_WIDE * 12)

    @F.pandas_udf("array<float>")
    def values(first: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bytes(x), "<f2").astype(np.float32) for x in first])

    texels = ktx2.read(spark, at).select(values(F.col("mips")[0]).alias("v"), "width").select("width", F.posexplode("v").alias("i", "shadow"))
    return texels.select((F.col("i") % F.col("width") + _X0).alias("px"), (F.floor(F.col("i") / F.col("width")) + _Y0).alias("py"), "shadow")


# --- messages --------------------------------------------------------------------------------------------

_GRIB_NAMES = ("t", "qv", "clc")
_GRIB_WIDE = 16
_GRIB = f"""g AS (SELECT ['t', 'qv', 'clc'][p_partkey % 3 + 1] AS var, p_size AS level, CAST(p_partkey // 3 // {_GRIB_WIDE} AS INT) AS iy, CAST(p_partkey // 3 % {_GRIB_WIDE} AS INT) AS ix, p_retailprice AS value FROM part)"""


def _grib_files(spark, sf) -> str:
    """Prices of parts as GRIB2 files, one per variable, a message per level on a grid 16 wide that grows with part; cells of other levels have no value."""
    at = scratch(spark, "grib")
    p = table(spark, sf, "part")
    high = p.agg(F.max("p_partkey")).first()[0] // 3 // _GRIB_WIDE + 1
    run = datetime(1995, 6, 13, 6)

    @F.pandas_udf("binary")
    def message(var: pd.Series, level: pd.Series, places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for n, lv, i, v in zip(var, level, places, values, strict=True):
            rows = np.full(high * _GRIB_WIDE, np.nan)
            rows[np.asarray(i, np.int64)] = v
            out.append(grib2.encode(rows.reshape(high, _GRIB_WIDE), n, "generalVertical", int(lv), run, 180, (43.0, 9.5), (0.02, 0.02), 24, 2))
        return pd.Series(out)

    @F.pandas_udf("binary")
    def together(messages: pd.Series) -> pd.Series:
        return pd.Series([b"".join(m) for m in messages])

    ship(spark)
    k = F.col("p_partkey")
    cells = p.select(F.get(F.array(*[F.lit(n) for n in _GRIB_NAMES]), (k % 3).cast("int")).alias("var"), F.col("p_size").alias("level"), F.struct(F.floor(k / 3).cast("int").alias("i"), F.col("p_retailprice").alias("v")).alias("c"))
    messages = cells.groupBy("var", "level").agg(F.collect_list("c").alias("c")).select("var", "level", message("var", "level", "c.i", "c.v").alias("m"))
    files = messages.groupBy("var").agg(F.array_sort(F.collect_list(F.struct("level", "m"))).alias("m")).select(F.concat("var", F.lit(".grib2")).alias("path"), together("m.m").alias("content"))
    tile_store.save(files, at)
    return at


@query("grib_fields", "var:s level:i iy:i ix:i value:d", f"WITH {_GRIB} SELECT * FROM g")
def grib_fields(spark, sf):
    """Messages packed from part and decoded again, each by its own range of its file."""
    return grib2.cube(grib2.fields(grib2.inventory(spark, _grib_files(spark, sf)))).withColumn("value", F.round(F.col("value").cast("double"), 2))


@query(
    "grib_region", "var:s level:i iy:i ix:i value:d",
    f"WITH {_GRIB} SELECT var, level, iy - 1 AS iy, ix - 2 AS ix, value FROM g WHERE var <> 'qv' AND level BETWEEN 10 AND 30 AND iy BETWEEN 1 AND 3 AND ix BETWEEN 2 AND 11",
)
def grib_region(spark, sf):
    """Some variables and levels, chosen from headers, cut to a box of coordinates that includes both ends."""
    found = grib2.inventory(spark, _grib_files(spark, sf)).filter("short_name <> 'qv' AND level BETWEEN 10 AND 30")
    return grib2.cube(grib2.fields(found, (43.02, 9.54, 43.06, 9.72))).withColumn("value", F.round(F.col("value").cast("double"), 2))


@query(
    "grib_inventory", "short_name:s type_of_level:s n:i least:i most:i points:i cells:i run:s minutes:i bits:i",
    f"WITH {_GRIB} SELECT var AS short_name, 'generalVertical' AS type_of_level, count(DISTINCT level) AS n, min(level) AS least, max(level) AS most, count(*) AS points, count(DISTINCT level) * (SELECT (max(p_partkey) // 3 // {_GRIB_WIDE} + 1) * {_GRIB_WIDE} FROM part) AS cells, '1995-06-13 06:00:00' AS run, 180 AS minutes, 24 AS bits FROM g GROUP BY var",
)
def grib_inventory(spark, sf):
    """The inventory of the same files from headers alone."""
    found = grib2.inventory(spark, _grib_files(spark, sf)).filter("error IS NULL")
    return found.groupBy("short_name", "type_of_level").agg(
        F.count("*").alias("n"), F.min("level").alias("least"), F.max("level").alias("most"), F.sum("points").alias("points"), F.sum(F.col("ni") * F.col("nj")).alias("cells"),
        F.date_format(F.max("run_ts"), "yyyy-MM-dd HH:mm:ss").alias("run"), F.max("step_minutes").alias("minutes"), F.max("bits").alias("bits"),
    )


# --- components ------------------------------------------------------------------------------------------


@query("components_all", "idx:i root:i")
@query("components", "idx:i root:i")
def grid_components(spark, sf):
    """Every line item as a cell: lines along x, orders in rows of 128 along y and z, so z grows with the table. The index is orderkey * 8 + linenumber.

    No SQL: recursion over all cells is too slow there; tests compare with union-find.
    """
    order = F.col("l_orderkey")
    c = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("x"), (order % 128).alias("y"), F.floor(order / 128).alias("z")).distinct()
    return components.grid_components(c, 8, 128).select(F.col("index").alias("idx"), "root")


_CIRRUS = f"""WITH {CELLS_SQL}, u AS (SELECT k % 50 AS root, CAST(k % 6 AS INT) AS z, CAST(k % 5 AS INT) AS y, CAST(k % 7 AS INT) AS x, clc, qc, qi, height FROM cells WHERE clc > 0),
f AS (SELECT root, sum(clc) AS mt, sum(CASE WHEN height > 7000 THEN clc ELSE 0 END) AS mh, avg(height) AS mean_height, count(*) AS n_cells, max(z) AS deepest FROM u GROUP BY root) SELECT root, mt, mh, mean_height, n_cells, deepest, CASE WHEN mean_height > 11000 THEN 2 WHEN mean_height > 9000 THEN 1 ELSE 0 END AS layer, mh / mt > 0.9 AS high FROM f"""


@query("cloud_figures_all", "root:i mt:d mh:d mean_height:d n_cells:i deepest:i layer:i high:b", _CIRRUS)
@query("cloud_figures", "root:i mt:d mh:d mean_height:d n_cells:i deepest:i layer:i high:b", _CIRRUS)
def cloud_figures(spark, sf):
    """The figures of all cloudy cells."""
    k = F.col("k")
    u = cells(spark, sf).filter("clc > 0").select((k % 50).alias("root"), (k % 6).cast("int").alias("z"), "clc", F.col("height").alias("h_mid"))
    f = components.cloud_figures(u)
    return f.select("root", F.col("mass_total").alias("mt"), F.col("mass_high").alias("mh"), "mean_height", "n_cells", "deepest", physics.cirrus_layer("mean_height").alias("layer"), physics.is_cirrus(F.lit(0.0), "mass_high", "mass_total").alias("high"))


_FLAT = """WITH f AS (SELECT l_orderkey % 20 AS root, CAST(l_orderkey % 6 AS INT) AS z, CAST(l_partkey % 5 AS INT) AS y, CAST(l_suppkey % 7 AS INT) AS x, (1 + l_orderkey % 9) / 10.0 AS clc, 2e-5 AS qc, 1e-5 AS qi, 13000.0 - (l_orderkey % 6) * 700 - (l_orderkey % 20) * 300 AS hu FROM lineitem),
n AS (SELECT *, hu - 1000.0 AS hl, hu - 500.0 AS hm FROM f), b AS (SELECT z, y, x, min(hl) AS base FROM n GROUP BY ALL),
s AS (SELECT root, sum(clc) AS mt, sum(CASE WHEN hm > 7000 THEN clc ELSE 0 END) AS mh, avg(hm) AS mean_height, max(z) AS deepest FROM n GROUP BY root),
j AS (SELECT n.*, s.mt, s.mh, s.mean_height, b.base, 1.225 * exp(-hm / 8400) AS rho FROM n JOIN s USING (root) LEFT JOIN b ON b.z = s.deepest AND b.y = n.y AND b.x = n.x)
SELECT CASE WHEN mean_height > 11000 THEN 2 WHEN mean_height > 9000 THEN 1 ELSE 0 END AS layer, y, x, sum((140 * pow(qc * rho * 1000, 0.7) + 60 * qi * rho * 1000) * (hu - hl)) AS optical_depth FROM j WHERE base > 7000 OR mh / mt > 0.9 GROUP BY ALL"""


@query("cirrus_flatten", "layer:i y:i x:i optical_depth:d", _FLAT)
def cirrus_flatten(spark, sf):
    c = F.col
    n = table(spark, sf, "lineitem").select(
        (c("l_orderkey") % 20).alias("root"), (c("l_orderkey") % 6).cast("int").alias("z"), (c("l_partkey") % 5).cast("int").alias("y"), (c("l_suppkey") % 7).cast("int").alias("x"),
        ((1 + c("l_orderkey") % 9) / 10.0).alias("clc"), F.lit(2e-5).alias("qc"), F.lit(1e-5).alias("qi"), (13000.0 - (c("l_orderkey") % 6) * 700 - (c("l_orderkey") % 20) * 300).alias("h_upper"),
    ).withColumn("h_lower", c("h_upper") - 1000.0)
    bases = n.groupBy("z", "y", "x").agg(F.min("h_lower").alias("h_lower"))
    return components.flatten_cirrus(n, bases)


# --- the smallest pipeline -----------------------------------------------------------------------------------


def flagship(spark, sf):
    """Voxels to a pyramid, a column projection and a shadow map per tile of a coarser zoom, and the five densest tiles."""
    coarse = volume.pyramid(voxels(spark, sf), ZOOM - 1, ZOOM, PIXELS).filter(F.col("zoom") == ZOOM - 1)
    dense = volume.column_sum(coarse, 0, LEVELS)
    shade = volume.shadow_map(coarse, LEVELS)
    both = dense.join(shade, ["zoom", "tx", "ty", "vy", "vx"])
    tiles = both.groupBy("zoom", "tx", "ty").agg(F.sum("density").alias("density"), F.max("density").alias("densest"), F.avg("shadow").alias("shadow"), F.count("*").alias("columns"))
    return tiles.orderBy(F.desc("density"), "tx", "ty").limit(5)


_FLAG = f"""{V}, c AS (SELECT 9 AS zoom, tx // 2 AS tx, ty // 2 AS ty, vz, ((ty * 16 + vy) // 2) % 16 AS vy, ((tx * 16 + vx) // 2) % 16 AS vx, sum(density) / 4 AS density FROM voxels GROUP BY ALL),
s AS (SELECT *, sum(density) OVER (PARTITION BY tx, ty, vy, vx ORDER BY vz) AS cum FROM c),
k AS (SELECT zoom, tx, ty, vy, vx, sum(density) AS density, exp(4.0 * coalesce(1 - min(CASE WHEN cum > 2.0 THEN vz END) / 8.0, 0.0)) AS shadow FROM s GROUP BY ALL)
SELECT zoom, tx, ty, sum(density) AS density, max(density) AS densest, avg(shadow) AS shadow, count(*) AS columns FROM k GROUP BY ALL ORDER BY density DESC, tx, ty LIMIT 5"""

query("flagship", "zoom:i tx:i ty:i density:d densest:d shadow:d columns:i", _FLAG)(flagship)
