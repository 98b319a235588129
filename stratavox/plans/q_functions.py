"""Queries over scalar functions: geography, interpolation, noise, physics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, half, interp, kernels, noise, physics, shear, text
from ..session import ship
from ..functions.noise import GRADIENTS, PRIMES
from .base import CELLS_SQL, NOW, POINTS_SQL, cells, points, query, spread, table

PI = "pi()"
R = "6378137.0"

# --- geography -----------------------------------------------------------------------------------

TILE_XY = "(lon + 180.0) / 360.0 * 1024 AS fx, (1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 1024 AS fy"


@query("tile_bin_z10", "tx:i ty:i n:i", f"WITH {POINTS_SQL} SELECT floor(fx) AS tx, floor(fy) AS ty, count(*) AS n FROM (SELECT {TILE_XY} FROM points) GROUP BY ALL")
def tile_bin(spark, sf):
    """Points per tile at zoom 10."""
    p = points(spark, sf).select(F.floor(geo.tile_x("lon", 10)).alias("tx"), F.floor(geo.tile_y("lat", 10)).alias("ty"))
    return p.groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query("tile_roundtrip", "k:i fx:d fy:d lon2:d lat2:d", f"WITH {POINTS_SQL} SELECT k, fx, fy, fx / 1024 * 360.0 - 180.0 AS lon2, degrees(atan(sinh(pi() * (1 - 2 * fy / 1024)))) AS lat2 FROM (SELECT k, {TILE_XY} FROM points)")
def tile_roundtrip(spark, sf):
    p = points(spark, sf).withColumns({"fx": geo.tile_x("lon", 10), "fy": geo.tile_y("lat", 10)})
    return p.withColumns({"lon2": geo.tile_lon("fx", 10), "lat2": geo.tile_lat("fy", 10)})


@query("xyz_to_tms", "k:i y:i tms:i back:i", f"WITH {POINTS_SQL} SELECT k, y, 1023 - y AS tms, y AS back FROM (SELECT k, floor(fy) AS y FROM (SELECT k, {TILE_XY} FROM points))")
def xyz_to_tms(spark, sf):
    p = points(spark, sf).withColumn("y", F.floor(geo.tile_y("lat", 10)).cast("int")).withColumn("tms", geo.flip_row("y", 10))
    return p.withColumn("back", geo.flip_row("tms", 10))


@query("mercator_roundtrip", "k:i mx:d my:d lon2:d lat2:d", f"WITH {POINTS_SQL} SELECT k, mx, my, degrees(mx / {R}) AS lon2, degrees(2 * atan(exp(my / {R})) - pi() / 2) AS lat2 FROM (SELECT k, radians(lon) * {R} AS mx, ln(tan(pi() / 4 + radians(lat) / 2)) * {R} AS my FROM points)")
def mercator_roundtrip(spark, sf):
    p = points(spark, sf).withColumns({"mx": geo.merc_x("lon"), "my": geo.merc_y("lat")})
    return p.withColumns({"lon2": geo.merc_lon("mx"), "lat2": geo.merc_lat("my")})


_BOUNDS = f"SELECT DISTINCT floor(fx) AS tx, floor(fy) AS ty FROM (SELECT {TILE_XY} FROM points)"


@query("tile_bounds", "tx:i ty:i left:d bottom:d right:d top:d res:d", f"WITH {POINTS_SQL}, t AS ({_BOUNDS}), w AS (SELECT 2 * pi() * {R} / 1024 AS w) SELECT tx, ty, tx * w - pi() * {R} AS \"left\", pi() * {R} - ty * w - w AS bottom, tx * w - pi() * {R} + w AS \"right\", pi() * {R} - ty * w AS top, w / 256 AS res FROM t, w")
def tile_bounds(spark, sf):
    t = points(spark, sf).select(F.floor(geo.tile_x("lon", 10)).alias("tx"), F.floor(geo.tile_y("lat", 10)).alias("ty")).distinct()
    return t.withColumn("b", geo.tile_bounds("tx", "ty", 10)).select("tx", "ty", "b.*", geo.resolution(10).alias("res"))


@query("world_scale", "k:i cos_lat:d wx:d wy:d", f"WITH {POINTS_SQL} SELECT k, cos(phi) AS cos_lat, mx * cos(phi) AS wx, {R} * phi AS wy FROM (SELECT k, mx, radians(degrees(2 * atan(exp(my / {R})) - pi() / 2)) AS phi FROM (SELECT k, radians(lon) * {R} AS mx, ln(tan(pi() / 4 + radians(lat) / 2)) * {R} AS my FROM points))")
def world_scale(spark, sf):
    p = points(spark, sf).withColumn("w", geo.world(geo.merc_x("lon"), geo.merc_y("lat")))
    return p.select("k", "w.cos_lat", F.col("w.x").alias("wx"), F.col("w.y").alias("wy"))


_BATCH = f"""WITH b AS (SELECT DISTINCT CAST(s_suppkey % 9 * 4 + 530 AS INT) AS bx, CAST(s_suppkey % 5 * 4 + 350 AS INT) AS "by" FROM supplier),
r AS (SELECT bx, "by", 2 * pi() * {R} / 1024 AS w, 2 * pi() * {R} / 1024 / 256 AS res FROM b),
c AS (SELECT bx, "by", res, bx * w - pi() * {R} - 32 * res AS l, pi() * {R} - "by" * w + 32 * res AS t FROM r),
g AS (SELECT *, degrees(l / {R}) AS west, degrees((l + 1088 * res) / {R}) AS east, degrees(2 * atan(exp(t / {R})) - pi() / 2) AS north, degrees(2 * atan(exp((t - 1088 * res) / {R})) - pi() / 2) AS south FROM c)
SELECT bx, "by", l AS "left", t AS top, res AS res_h, 218.75 AS res_v, (west - 9.4) / 0.02 AS offset_x, (north - 46.2) / 0.02 AS offset_y, (east - west) / 0.02 / 1088 AS scale_x, (south - north) / 0.02 / 1088 AS scale_y FROM g"""


@query("batch_parameters", "bx:i by:i left:d top:d res_h:d res_v:d offset_x:d offset_y:d scale_x:d scale_y:d", _BATCH)
def batch_parameters(spark, sf):
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") % 9 * 4 + 530).cast("int").alias("bx"), (F.col("s_suppkey") % 5 * 4 + 350).cast("int").alias("by")).distinct()
    return b.withColumn("p", geo.batch_parameters("bx", "by", 10, 46.2, 9.4, 0.02, 0.02)).select("bx", "by", "p.*")


_CROP = f"""WITH {POINTS_SQL}, m AS (SELECT k, radians(lon) * {R} AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * {R} AS y FROM points),
f AS (SELECT k, (x - 900000.0) / 500.0 AS fx0, (x + 60000.0 - 900000.0) / 500.0 AS fx1, (6400000.0 - (y + 40000.0)) / 500.0 AS fy0, (6400000.0 - y) / 500.0 AS fy1 FROM m)
SELECT k, least(greatest(floor(fx0), 0), 1024) AS px0, least(greatest(ceil(fx1), 0), 1024) AS px1, least(greatest(floor(fy0), 0), 768) AS py0, least(greatest(ceil(fy1), 0), 768) AS py1 FROM f"""


@query("crop_pixels", "k:i px0:i px1:i py0:i py1:i", _CROP)
def crop_pixels(spark, sf):
    p = points(spark, sf).withColumns({"x": geo.merc_x("lon"), "y": geo.merc_y("lat")})
    return p.withColumn("c", geo.crop_pixels("x", "y", F.col("x") + 60000.0, F.col("y") + 40000.0, F.lit(900000.0), F.lit(6400000.0), F.lit(500.0), 1024, 768)).select("k", "c.*")


_EQUI = """WITH r AS (SELECT i AS row_out, 49.2 - 3.0 * (i + 0.5) / 512 AS lat FROM range(512) t(i)), m AS (SELECT row_out, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y, ln(tan(pi() / 4 + radians(49.2) / 2)) * 6378137.0 AS y1, ln(tan(pi() / 4 + radians(46.2) / 2)) * 6378137.0 AS y0 FROM r)
SELECT row_out, least(greatest(floor((y1 - y) / (y1 - y0) * 512), 0), 511) AS row_in FROM m"""


@query("equirect_rows", "row_out:i row_in:i", _EQUI)
def equirect_rows(spark, sf):
    return spark.range(512).select(F.col("id").alias("row_out"), geo.equirect_row(F.col("id"), 512, 49.2, 46.2).alias("row_in"))


@query("day_offset", "o_orderkey:i days:i", f"SELECT o_orderkey, date_diff('day', DATE '{NOW[:10]}', CAST(o_orderdate AS DATE)) AS days FROM orders")
def day_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", geo.day_offset("o_orderdate", F.lit(NOW).cast("timestamp")).alias("days"))


# --- interpolation -----------------------------------------------------------------------------------

_T = "l_discount * 9.7 + l_tax"
_BSPLINE = f"SELECT k, pow(1 - t, 3) / 6 AS w0, (3 * t * t * t - 6 * t * t + 4) / 6 AS w1, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6 AS w2, t * t * t / 6 AS w3 FROM (SELECT l_orderkey * 8 + l_linenumber AS k, ({_T}) - floor({_T}) AS t FROM lineitem)"


@query("bspline_weights", "k:i w0:d w1:d w2:d w3:d", _BSPLINE)
def bspline(spark, sf):
    x = F.col("l_discount") * 9.7 + F.col("l_tax")
    w = interp.bspline_weights(x - F.floor(x))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), *[v.alias(f"w{i}") for i, v in enumerate(w)])


PCHIP_SQL = """
s AS (SELECT *, z0 - z1 AS h0, z1 - z2 AS h1, z2 - z3 AS h2 FROM nodes),
d AS (SELECT *, CASE WHEN h0 > 1e-3 THEN (v0 - v1) / nullif(h0, 0) ELSE 0.0 END AS s0, (v1 - v2) / nullif(h1, 0) AS s1, CASE WHEN h2 > 1e-3 THEN (v2 - v3) / nullif(h2, 0) ELSE 0.0 END AS s2 FROM s),
m AS (SELECT *, CASE WHEN s0 * s1 <= 0 THEN 0.0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / nullif(s0, 0) + (h1 + 2 * h0) / nullif(s1, 0)) END AS m1,
  CASE WHEN s1 * s2 <= 0 THEN 0.0 ELSE (3 * h2 + 3 * h1) / ((2 * h2 + h1) / nullif(s1, 0) + (h2 + 2 * h1) / nullif(s2, 0)) END AS m2 FROM d),
f AS (SELECT *, CASE WHEN abs(s1) > 1e-10 AND (m1 / nullif(s1, 0)) ** 2 + (m2 / nullif(s1, 0)) ** 2 > 9 THEN 3 / sqrt((m1 / nullif(s1, 0)) ** 2 + (m2 / nullif(s1, 0)) ** 2) ELSE 1.0 END AS lim, (z1 - z) / nullif(h1, 0) AS t FROM m),
done AS (SELECT *, CASE WHEN abs(h1) < 1e-3 THEN v1 ELSE (2*t*t*t - 3*t*t + 1) * v1 + (t*t*t - 2*t*t + t) * (-h1) * lim * m1 + (3*t*t - 2*t*t*t) * v2 + (t*t*t - t*t) * (-h1) * lim * m2 END AS value FROM f)"""

_NODES = """nodes AS (SELECT l_orderkey * 8 + l_linenumber AS k, 900.0 + l_partkey % 70 AS z0, 600.0 + l_partkey % 90 AS z1, 300.0 + l_suppkey % 80 AS z2, CASE WHEN l_linenumber = 7 THEN 300.0 + l_suppkey % 80 ELSE 0.0 END AS z3,
  l_quantity AS v0, l_discount * 300 AS v1, l_tax * 400 AS v2, l_partkey % 31 AS v3, 300.0 + l_suppkey % 80 + (l_orderkey % 100) / 100.0 * (300.0 + l_partkey % 90 - l_suppkey % 80) AS z FROM lineitem)"""


@query("pchip_profile", "k:i value:d", f"WITH {_NODES},{PCHIP_SQL} SELECT k, value FROM done")
def pchip_profile(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem")
    z1, z2 = 600.0 + c("l_partkey") % 90, 300.0 + c("l_suppkey") % 80
    z = [900.0 + c("l_partkey") % 70, z1, z2, F.when(c("l_linenumber") == 7, z2).otherwise(0.0)]
    v = [c("l_quantity"), c("l_discount") * 300, c("l_tax") * 400, c("l_partkey") % 31]
    return li.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("k"), interp.pchip(z, v, z2 + (c("l_orderkey") % 100) / 100.0 * (z1 - z2)).alias("value"))


@query("smoothstep", "k:i s:d l:d c:d", f"WITH {CELLS_SQL} SELECT k, u * u * (3 - 2 * u) AS s, qv + clc * (tke - qv) AS l, u AS c FROM (SELECT *, least(greatest((tke - 0.2) / 1.1, 0.0), 1.0) AS u FROM cells)")
def smoothstep(spark, sf):
    return cells(spark, sf).select("k", interp.smoothstep(0.2, 1.3, "tke").alias("s"), interp.lerp("qv", "tke", "clc").alias("l"), interp.saturate((F.col("tke") - 0.2) / 1.1).alias("c"))


@query("edge_indices", "k:i clamped:i reflected:i", "SELECT k, least(greatest(i, 0), 15) AS clamped, least(((i % 32) + 32) % 32, 31 - ((i % 32) + 32) % 32) AS reflected FROM (SELECT p_partkey AS k, p_partkey % 57 - 21 AS i FROM part)")
def edge_indices(spark, sf):
    i = F.col("p_partkey") % 57 - 21
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), interp.clamp_index(i, F.lit(16)).alias("clamped"), interp.reflect_index(i, F.lit(16)).alias("reflected"))


@query("round_half", "k:i value:d", "SELECT k, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / u, 0) * u END AS value FROM (SELECT k, x, greatest(pow(2.0, floor(log2(abs(nullif(x, 0)))) - 10), pow(2.0, -24)) AS u FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_extendedprice / 7.0 - 3000 AS x FROM lineitem)) WHERE abs(x) < 65504")
def round_half(spark, sf):
    x = F.col("l_extendedprice") / 7.0 - 3000
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), x.alias("x")).filter(F.abs("x") < 65504).withColumn("value", half.round_half("x"))


# --- noise ---------------------------------------------------------------------------------------

NOISE_POINTS = "noise_points AS (SELECT p_partkey AS k, p_size * 0.37 - 7.0 AS x, (p_partkey % 83) * 0.211 - 5.0 AS y, p_retailprice * 0.0131 AS z FROM part)"


def _noise_points(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(c("p_partkey").alias("k"), (c("p_size") * 0.37 - 7.0).alias("x"), ((c("p_partkey") % 83) * 0.211 - 5.0).alias("y"), (c("p_retailprice") * 0.0131).alias("z"))


def _noised(spark, sf, kind: str, octaves: int):
    """Noise at the points by batches; tests hold it against the native columns."""
    ship(spark)
    return spread(_noise_points(spark, sf), "k").select("k", kernels.noise_value(kind, "x", "y", "z", octaves).alias("v"))


def _hash_sql(source: str, x: str, y: str, z: str, out: str, keep: str) -> str:
    """A query that adds the lattice hash of three whole numbers to `source`, one step a level."""
    u = lambda v: f"((({v}) % 4294967296) + 4294967296) % 4294967296"
    mul = lambda v, p: f"CAST((CAST({v} AS HUGEINT) * {p}) % 4294967296 AS BIGINT)"
    first = f"xor(xor({mul(u(x), PRIMES[0])}, {mul(u(y), PRIMES[1])}), {mul(u(z), PRIMES[2])})"
    step = f"SELECT {keep}, {first} AS h FROM {source}"
    for shift, prime in ((16, PRIMES[1]), (13, PRIMES[2])):
        step = f"SELECT {keep}, {mul(f'xor(h, h >> {shift})', prime)} AS h FROM ({step})"
    return f"SELECT {keep}, xor(h, h >> 16) AS {out} FROM ({step})"


def perlin_sql(name: str, source: str) -> str:
    """CTEs that end in `name` (k, o, v): gradient noise of rows (k, o, x, y, z) of `source`."""
    case = lambda axis: "CASE h & 15 " + " ".join(f"WHEN {i} THEN {g[axis]}" for i, g in enumerate(GRADIENTS)) + " END"
    fade = lambda t: f"{t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10)"
    side = lambda a: f"CASE WHEN d{a} = 1 THEN {fade('f' + a)} ELSE 1 - {fade('f' + a)} END"
    keep = "k, o, dx, dy, dz, fx, fy, fz"
    return f"""
{name}_c AS (SELECT k, o, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz FROM {source}),
{name}_n AS (SELECT k, o, fx, fy, fz, ix + dx AS cx, iy + dy AS cy, iz + dz AS cz, dx, dy, dz FROM {name}_c, (VALUES (0),(1)) a(dx), (VALUES (0),(1)) b(dy), (VALUES (0),(1)) c(dz)),
{name}_h AS ({_hash_sql(f'{name}_n', 'cx', 'cy', 'cz', 'h', keep)}),
{name} AS (SELECT k, o, 0.5 + 0.5 * sum(({case(0)} * (fx - dx) + {case(1)} * (fy - dy) + {case(2)} * (fz - dz)) * ({side('x')}) * ({side('y')}) * ({side('z')})) AS v FROM {name}_h GROUP BY k, o)"""


def worley_sql(name: str, source: str, value: str = "1 - sqrt(d2)") -> str:
    """CTEs that end in `name` (k, o, v): cellular noise of rows (k, o, x, y, z) of `source`."""
    keep = "k, o, dx, dy, dz, fx, fy, fz"
    return f"""
{name}_c AS (SELECT k, o, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz FROM {source}),
{name}_n AS (SELECT k, o, fx, fy, fz, ix + dx AS cx, iy + dy AS cy, iz + dz AS cz, dx, dy, dz FROM {name}_c, (VALUES (-1),(0),(1)) a(dx), (VALUES (-1),(0),(1)) b(dy), (VALUES (-1),(0),(1)) c(dz)),
{name}_1 AS ({_hash_sql(f'{name}_n', 'cx', 'cy', 'cz', 'h1', keep)}),
{name}_2 AS ({_hash_sql(f'{name}_1', 'h1', '0', '0', 'h2', keep + ', h1')}),
{name}_3 AS ({_hash_sql(f'{name}_2', 'h2', '0', '0', 'h3', keep + ', h1, h2')}),
{name}_m AS (SELECT k, o, min((dx + (h1 & 65535) / 65535.0 - fx) ** 2 + (dy + (h2 & 65535) / 65535.0 - fy) ** 2 + (dz + (h3 & 65535) / 65535.0 - fz) ** 2) AS d2 FROM {name}_3 GROUP BY k, o),
{name} AS (SELECT k, o, {value} AS v FROM {name}_m)"""


def octaves_sql(name: str, source: str, n: int) -> str:
    return f"{name} AS (SELECT k, o, x * pow(2, o) AS x, y * pow(2, o) AS y, z * pow(2, o) AS z FROM {source}, range({n}) r(o))"


def fbm_sql(name: str, source: str, kind: str, n: int) -> str:
    """CTEs that end in `name` (k, v): octaves of a noise over rows (k, x, y, z)."""
    make = {"perlin": lambda a, b: perlin_sql(a, b), "worley": lambda a, b: worley_sql(a, b), "squared": lambda a, b: worley_sql(a, b, "1 - d2")}[kind]
    return f"""{octaves_sql(f'{name}_o', source, n)},{make(f'{name}_v', f'{name}_o')},
{name} AS (SELECT k, 0.5 + sum((v - 0.5) * 0.5 / pow(2, o)) AS v FROM {name}_v GROUP BY k)"""


_ONE = "one AS (SELECT k, 0 AS o, x, y, z FROM noise_points)"


@query("hash33", "k:i h:i", "WITH p AS (SELECT p_partkey AS k, p_size - 20 AS a, p_partkey * 31 - 500 AS b, p_size * p_size AS c FROM part) " + _hash_sql("p", "a", "b", "c", "h", "k"))
def hash33(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(c("p_partkey").alias("k"), noise.hash3(c("p_size") - 20, c("p_partkey") * 31 - 500, c("p_size") * c("p_size")).alias("h"))


@query("perlin", "k:i v:d", f"WITH {NOISE_POINTS}, {_ONE},{perlin_sql('n', 'one')} SELECT k, v FROM n")
def perlin(spark, sf):
    return _noise_points(spark, sf).select("k", noise.perlin("x", "y", "z").alias("v"))


@query("worley", "k:i v:d sq:d", f"WITH {NOISE_POINTS}, {_ONE},{worley_sql('n', 'one', '1 - d2')} SELECT k, 1 - sqrt(1 - v) AS v, v AS sq FROM n")
def worley(spark, sf):
    return _noised(spark, sf, "worley_squared", 0).select("k", (1.0 - F.sqrt(1.0 - F.col("v"))).alias("v"), F.col("v").alias("sq"))


@query("fbm_gradient", "k:i v:d", f"WITH {NOISE_POINTS}, {fbm_sql('f', 'noise_points', 'perlin', 3)} SELECT k, v FROM f")
def fbm_gradient(spark, sf):
    return _noised(spark, sf, "perlin", 3)


@query("fbm_worley", "k:i v:d", f"WITH {NOISE_POINTS}, {fbm_sql('f', 'noise_points', 'worley', 2)} SELECT k, v FROM f")
def fbm_worley(spark, sf):
    return _noised(spark, sf, "worley", 2)


@query("fbm_worley_biased", "k:i v:d", f"WITH {NOISE_POINTS}, {fbm_sql('f', 'noise_points', 'squared', 2)} SELECT k, v FROM f")
def fbm_biased(spark, sf):
    return _noised(spark, sf, "worley_squared", 2)


@query("fbm_normalised", "k:i v:d", f"WITH {NOISE_POINTS}, {octaves_sql('oc', 'noise_points', 2)},{perlin_sql('n', 'oc')} SELECT k, sum(v * 0.5 / pow(2, o)) / 0.75 AS v FROM n GROUP BY k")
def fbm_normalised(spark, sf):
    return _noise_points(spark, sf).select("k", noise.fbm_normal(noise.perlin, "x", "y", "z", 2).alias("v"))


_SAT = "sat AS (SELECT k, 0 AS o, greatest(floor(x), 0) + x - floor(x) AS x, greatest(floor(y), 0) + y - floor(y) AS y, greatest(floor(z), 0) + z - floor(z) AS z FROM noise_points)"


@query("worley_saturating", "k:i v:d", f"WITH {NOISE_POINTS}, {_SAT},{worley_sql('n', 'sat', '1 - sqrt(least(d2, 1.0))')} SELECT k, v FROM n")
def worley_saturating(spark, sf):
    return _noised(spark, sf, "worley_saturating", 0)


TURBULENT = "turbulent AS (SELECT p_partkey AS k, p_size * 911.7 - 9000.0 AS x, (p_partkey % 83) * 433.1 AS y, (p_partkey % 70) * 150.0 + 75.0 AS z, (p_size % 7) * 0.4 AS tke, (p_partkey % 21) / 20.0 AS clc, (p_size % 5) * 0.6 AS w, ((p_partkey % 13) - 6) * 0.004 AS du, ((p_size % 11) - 5) * 0.003 AS dv FROM part)"


def _turbulent(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(
        c("p_partkey").alias("k"), (c("p_size") * 911.7 - 9000.0).alias("x"), ((c("p_partkey") % 83) * 433.1).alias("y"), ((c("p_partkey") % 70) * 150.0 + 75.0).alias("z"), ((c("p_size") % 7) * 0.4).alias("tke"),
        ((c("p_partkey") % 21) / 20.0).alias("clc"), ((c("p_size") % 5) * 0.6).alias("w"), (((c("p_partkey") % 13) - 6) * 0.004).alias("du"), (((c("p_size") % 11) - 5) * 0.003).alias("dv"),
    )


def _scaled_sql(name: str, kind: str, n: int, xy: float, z: float, offset: tuple = (0, 0, 0)) -> str:
    return f"{name}_p AS (SELECT k, x / {xy} + {offset[0]} AS x, y / {xy} + {offset[1]} AS y, z / {z} + {offset[2]} AS z FROM turbulent), {fbm_sql(name, f'{name}_p', kind, n)}"


_DISPLACE = f"""WITH {TURBULENT}, {_scaled_sql('nx', 'perlin', 2, 800.0, 800.0, (17.3, 0, 0))}, {_scaled_sql('ny', 'perlin', 2, 800.0, 800.0, (0, 31.7, 0))}, {_scaled_sql('nz', 'perlin', 2, 800.0, 800.0, (0, 0, 53.1))},
a AS (SELECT k, sqrt(tke * 2 / 3) AS s FROM turbulent), b AS (SELECT k, CASE WHEN s <= 0.01 THEN 0.0 ELSE least(s / sqrt(10.0 / 3), 1.0) * 500 END AS amp FROM a)
SELECT k, (nx.v - 0.5) * amp AS dx, (ny.v - 0.5) * amp AS dy, (nz.v - 0.5) * amp AS dz FROM b JOIN nx USING (k) JOIN ny USING (k) JOIN nz USING (k)"""


@query("displacement", "k:i dx:d dy:d dz:d", _DISPLACE)
def displacement(spark, sf):
    ship(spark)
    return spread(_turbulent(spark, sf), "k").select("k", kernels.displacement("x", "y", "z", "tke").alias("d")).select("k", "d.*")


_ss = lambda a, b, x: f"(least(greatest(({x} - {a}) / ({b} - {a}), 0.0), 1.0) ** 2 * (3 - 2 * least(greatest(({x} - {a}) / ({b} - {a}), 0.0), 1.0)))"
_FACTOR = f"""WITH {TURBULENT}, {_scaled_sql('a1', 'perlin', 2, 2000.0, 1000.0)}, {_scaled_sql('a2', 'perlin', 2, 3000.0, 2000.0)}, {_scaled_sql('a3', 'perlin', 3, 2200.0, 1500.0)}, {_scaled_sql('a4', 'perlin', 3, 800.0, 400.0)},
{_scaled_sql('a5', 'perlin', 4, 1500.0, 2000.0)}, {_scaled_sql('a6', 'worley', 3, 600.0, 1300.0)}, {_scaled_sql('a7', 'worley', 3, 150.0, 150.0)},
w AS (SELECT t.k, clc, tke, greatest({_ss(0.05, 0.5, 'tke')} * (1 - {_ss(5000.0, 8000.0, 'z')}), {_ss(0.8, 1.5, 'tke')}) AS cv, a1.v AS inside, a2.v - 0.5 AS edge, a3.v - 0.5 AS lg, a4.v - 0.5 AS md, a5.v * a6.v * a7.v AS tex
  FROM turbulent t JOIN a1 ON a1.k = t.k JOIN a2 ON a2.k = t.k JOIN a3 ON a3.k = t.k JOIN a4 ON a4.k = t.k JOIN a5 ON a5.k = t.k JOIN a6 ON a6.k = t.k JOIN a7 ON a7.k = t.k),
p AS (SELECT *, edge * 0.4 * clc * (1 - clc) * 4 AS slab, (lg * 0.7 + md * 0.4) * {_ss(0.0, 0.15, 'clc')} * 1.5 AS tower, 1.0 + cv * (0.5 - 1.0) AS up FROM w),
q AS (SELECT *, least(greatest(clc + slab + cv * (tower - slab), 0.0), 1.0) AS base FROM p),
r AS (SELECT *, {_ss('0.0', 'up', 'base')} AS shaped FROM q),
s AS (SELECT *, greatest(1 + (tex - 0.125) * 6, 0.3) * (1 - least(greatest(tke * 0.5, 0.0), 1.0) * 0.3) AS bumps, {_ss(0.2, 0.8, 'shaped')} AS core FROM r)
SELECT k, shaped * ((inside * 0.4 + 0.6) + cv * ((bumps + core * (1 - bumps)) - (inside * 0.4 + 0.6))) AS factor FROM s"""


@query("density_factor", "k:i factor:d", _FACTOR)
def density_factor(spark, sf):
    ship(spark)
    return spread(_turbulent(spark, sf), "k").select("k", kernels.density_factor("x", "y", "z", "clc", "tke").alias("factor"))


@query("density_factor_native", "k:i factor:d", _FACTOR)
def density_factor_native(spark, sf):
    """The same rows by the same kernel: by native columns, which tests compare it with, a voxel took some 15 ms. Kept because queries are never deleted."""
    return density_factor(spark, sf)


# --- physics --------------------------------------------------------------------------------------


@query("clc_remap", "k:i part:d percent:d", f"WITH {CELLS_SQL} SELECT k, CASE WHEN clc < 0.001 THEN 0 ELSE (clc - 0.001) / 0.999 END AS part, CASE WHEN clc * 0.01 < 0.001 THEN 0 ELSE (clc * 0.01 - 0.001) / 0.999 END AS percent FROM cells")
def clc_remap(spark, sf):
    return cells(spark, sf).select("k", physics.remap_cover("clc").alias("part"), physics.remap_cover("clc", True).alias("percent"))


@query("stored_units", "k:i qc:d p:d t:d", f"WITH {CELLS_SQL} SELECT k, qc * 10000 AS qc, p / 1000 AS p, t FROM cells")
def stored_units(spark, sf):
    return cells(spark, sf).select("k", *[physics.scale_stored(n, n).alias(n) for n in ("qc", "p", "t")])


@query("cloud_mask", "n:i mean_qc:d", f"WITH {CELLS_SQL} SELECT count(*) AS n, avg(qc) * 1e6 AS mean_qc FROM cells WHERE clc * 100 > 1.0 AND qc > 1e-6")
def cloud_mask(spark, sf):
    return cells(spark, sf).filter(physics.is_cloud(F.col("clc") * 100, "qc")).agg(F.count("*").alias("n"), (F.avg("qc") * 1e6).alias("mean_qc"))


@query("condensate", "k:i qc6:d qi6:d", f"WITH {CELLS_SQL} SELECT k, 3e-5 * clc * (1 - ice) * 1e6 AS qc6, 3e-5 * clc * ice * 1e6 AS qi6 FROM (SELECT *, least(greatest((273.15 - t) / 38.0, 0.0), 1.0) AS ice FROM cells)")
def condensate(spark, sf):
    q = physics.condensate("t", "clc")
    return cells(spark, sf).select("k", (q["qc"] * 1e6).alias("qc6"), (q["qi"] * 1e6).alias("qi6"))


_COVER = "cover AS (SELECT *, greatest(clc, least(greatest((qc + qi) / 3e-5, 0.0), 1.0)) AS cov FROM cells)"


@query("effective_cover", "k:i cov:d qc6:d qi6:d", f"WITH {CELLS_SQL}, {_COVER} SELECT k, cov, CASE WHEN cov > 0 AND t > 180 AND p > 100 THEN greatest(qc, 3e-5 * cov * (1 - ice)) ELSE qc END * 1e6 AS qc6, CASE WHEN cov > 0 AND t > 180 AND p > 100 THEN greatest(qi, 3e-5 * cov * ice) ELSE qi END * 1e6 AS qi6 FROM (SELECT *, least(greatest((273.15 - t) / 38.0, 0.0), 1.0) AS ice FROM cover)")
def effective_cover(spark, sf):
    c = cells(spark, sf).withColumn("cov", physics.effective_cover("clc", "qc", "qi"))
    q = physics.restored_condensate("cov", "qc", "qi", "t", "p")
    return c.select("k", "cov", (q["qc"] * 1e6).alias("qc6"), (q["qi"] * 1e6).alias("qi6"))


_BETA = f"""{_COVER}, rho AS (SELECT *, p / (287.05 * t * (1 + 0.608 * qv)) AS rho FROM cover),
wc AS (SELECT *, qc / greatest(cov, 0.001) * rho AS lwc, qi / greatest(cov, 0.001) * rho AS iwc FROM rho),
ice AS (SELECT *, least(greatest(t - 273.15, -70.0), -5.0) AS tc, least(greatest(iwc * 1000, 0.0001), 0.3) AS g FROM wc),
rad AS (SELECT *, 100 * pow(lwc * 1000 * 3.0 / (4 * pi() * 200), 1.0 / 3) * 1e-6 AS rl, (45.8966 * pow(g, 0.2214) + 0.7957 * pow(g, 0.2535) * (tc + 190)) * (1.2351 + 0.0105 * tc) * (3 * sqrt(3.0) / 8) * 1e-6 AS ri FROM ice),
beta AS (SELECT *, 1000 * (CASE WHEN lwc > 1e-7 THEN 1.5 * lwc / (1000 * least(greatest(rl, 4e-6), 15e-6)) ELSE 0 END + CASE WHEN iwc > 1e-7 THEN 1.5 * iwc / (917 * least(greatest(ri, 10e-6), 150e-6)) ELSE 0 END) AS beta FROM rad)"""


@query("extinction", "k:i rho:d beta:d", f"WITH {CELLS_SQL}, {_BETA} SELECT k, rho, beta FROM beta")
def extinction(spark, sf):
    c = cells(spark, sf).withColumn("cov", physics.effective_cover("clc", "qc", "qi"))
    return c.select("k", physics.air_density("t", "p", "qv").alias("rho"), physics.extinction("qc", "qi", "qv", "t", "p", "cov").alias("beta"))


@query("terrain_fade", "k:i fade:d plain:d full:d", f"WITH {CELLS_SQL}, {_BETA} SELECT k, f AS fade, beta * cov * f AS plain, beta * least(greatest(tke, 0.0), 2.0) * f AS \"full\" FROM (SELECT *, least(greatest((height - ground) / 200, 0.0), 1.0) AS f FROM beta)")
def terrain_fade(spark, sf):
    c = cells(spark, sf).withColumn("cov", physics.effective_cover("clc", "qc", "qi")).withColumn("beta", physics.extinction("qc", "qi", "qv", "t", "p", "cov"))
    return c.select("k", physics.terrain_fade("height", "ground").alias("fade"), physics.voxel_plain("beta", "cov", "height", "ground").alias("plain"), physics.voxel("beta", "tke", "height", "ground").alias("full"))


_BILLOW = f"""WITH {TURBULENT}, s AS (SELECT *, sqrt(du * du + dv * dv) AS sh FROM turbulent),
a AS (SELECT *, least(greatest((0.25 - 1 / (1 + tke * sh * 200)) / 0.25, 0.0), 1.0) AS st, 7.07 * least(greatest(sqrt(2 * tke) / nullif(sh, 0), 50.0), 500.0) AS wl, du / nullif(sh, 0) AS nx, dv / nullif(sh, 0) AS ny FROM s),
b AS (SELECT *, (x * nx + y * ny) / wl * 2 * pi() AS ph, st * 0.3 * wl AS am FROM a)
SELECT k, CASE WHEN sh > 1e-4 THEN x + sin(ph) * am * nx ELSE x END AS bx, CASE WHEN sh > 1e-4 THEN y + sin(ph) * am * ny ELSE y END AS "by", CASE WHEN sh > 1e-4 THEN z + cos(ph) * am ELSE z END AS bz FROM b"""


@query("kh_billow", "k:i bx:d by:d bz:d", _BILLOW)
def kh_billow(spark, sf):
    t = _turbulent(spark, sf).withColumn("b", physics.billow("x", "y", "z", "du", "dv", "tke", 200.0))
    return t.select("k", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.z").alias("bz"))


#: Lengths of the shear variant's noise, in metres: horizontal, vertical.
SCALES = {"stratus": (2000.0, 1000.0), "small": (1000.0, 600.0), "middle": (2000.0, 1000.0), "large": (4000.0, 1500.0), "detail": (500.0, 250.0), "perturb": (3000.0, 2000.0)}


@query("shear_density", "k:i density:d beta:d")
def shear_density(spark, sf):
    """No SQL, for the noise at six scales; tests compare it with plain arithmetic."""
    ship(spark)
    t = spread(_turbulent(spark, sf), "k")
    return t.select("k", shear.shear_density("x", "y", "z", "clc", "tke", "w", SCALES).alias("density"), physics.extinction_shear(F.lit(1e-5), F.lit(1e-6), F.lit(1e-3), F.lit(260.0), F.lit(7e4), "clc").alias("beta"))


@query("legacy_extinction", "k:i rho:d beta:d", f"WITH {CELLS_SQL} SELECT k, rho, 140 * pow(qc * rho * 1000, 0.7) + 60 * qi * rho * 1000 AS beta FROM (SELECT *, 1.225 * exp(-height / 8400) AS rho FROM cells)")
def legacy_extinction(spark, sf):
    c = cells(spark, sf).withColumn("rho", physics.barometric_density("height"))
    return c.select("k", "rho", physics.extinction_legacy("qc", "qi", "rho").alias("beta"))


# --- text ---------------------------------------------------------------------------------------------

_RUN = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' || o_orderkey ELSE strftime(o_orderdate, '%Y%m%d%H') END AS s, CAST(o_orderkey % 49 AS INT) AS step FROM orders"


@query("run_times", "o_orderkey:i folder:s target:s", f"SELECT o_orderkey, s || '_' || lpad(CAST(step AS VARCHAR), 3, '0') AS folder, strftime(try_strptime(s, '%Y%m%d%H') + step * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS target FROM ({_RUN})")
def run_times(spark, sf):
    from .base import stamp

    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("bad"), "o_orderkey")).otherwise(text.run_text("o_orderdate")).alias("s"), (F.col("o_orderkey") % 49).cast("int").alias("step"))
    return o.select("o_orderkey", text.folder("s", "step").alias("folder"), stamp(text.target_time(text.run_time("s"), "step")).alias("target"))


_NAMES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'note_' || p_partkey || '.txt' ELSE 'tile_' || (p_size % 12) || '_' || (p_partkey % 1000) || '_' || p_size || '.ktx2' END AS name FROM part"


@query("tile_names", "k:i zoom:i x:i y:i level:i", f"SELECT k, CASE WHEN name LIKE 'tile%' THEN CAST(split_part(name, '_', 2) AS INT) END AS zoom, CASE WHEN name LIKE 'tile%' THEN CAST(split_part(name, '_', 3) AS INT) END AS x, CASE WHEN name LIKE 'tile%' THEN CAST(regexp_extract(name, '_(\\d+)\\.', 1) AS INT) END AS y, CAST(regexp_extract(name, '_(\\d+)\\.', 1) AS INT) AS level FROM ({_NAMES})")
def tile_names(spark, sf):
    c = F.col
    name = F.when(c("p_partkey") % 7 == 0, F.concat(F.lit("note_"), "p_partkey", F.lit(".txt"))).otherwise(F.concat(F.lit("tile_"), c("p_size") % 12, F.lit("_"), c("p_partkey") % 1000, F.lit("_"), "p_size", F.lit(".ktx2")))
    return table(spark, sf, "part").select(c("p_partkey").alias("k"), text.tile_name(name).alias("t"), text.level_of(name).alias("level")).select("k", "t.zoom", "t.x", "t.y", "level")


@query("badge_version", "k:i version:s", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_size || '.' || (p_partkey % 10) END AS version FROM part")
def badge_version(spark, sf):
    body = F.when(F.col("p_partkey") % 3 == 0, F.lit("no badge")).otherwise(F.concat(F.lit("![v](https://img.shields.io/badge/version-"), "p_size", F.lit("."), F.col("p_partkey") % 10, F.lit("-blue)")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.badge_version(body).alias("version"))
