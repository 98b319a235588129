"""Registry of queries, and the weather-like tables derived from the driver's columns.

A query has a column spec (`name:kind`, kinds i, d, s, b), a Spark function and, where SQL can express it,
SQL. Both sides end in the same casts: i as BIGINT, d as DOUBLE to six decimals (shifted by 1e-10, so that
halves round alike), s as text, b as boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPARK = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double") + F.lit(1e-10), 6) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
_DUCK = {"i": "CAST({} AS BIGINT)", "d": "round(CAST({} AS DOUBLE) + 1e-10, 6) + 0.0", "s": "CAST({} AS VARCHAR)", "b": "CAST({} AS BOOLEAN)"}


def query(name: str, spec: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with the SQL of the same rows."""
    fields = [x.split(":") for x in spec.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[_SPARK[kind](F.col(c)).alias(c) for c, kind in fields])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = f"WITH inner_rows AS (\n{sql}\n)\nSELECT {', '.join(_DUCK[kind].format(f'"{c}"') + f' AS "{c}"' for c, kind in fields)} FROM inner_rows"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without zone become timestamps in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt anew by key, some tasks for each core: a file of few row groups is read by as few tasks, however costly its rows are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def stamp(c):
    """A time as text, for comparison."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


#: A time as text in SQL.
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

#: "Now" of all queries that need one.
NOW, TODAY = "1995-06-15 13:40:00", "1995-06-15"
PIXELS, LEVELS, ZOOM = 16, 8, 10
#: Parts of a column of tiles.
PARTS = 64
#: Sides, all odd, of the volumes that are halved and padded.
ODD = (7, 15, 13)

# --- voxels ------------------------------------------------------------------------------------

VOXELS_SQL = """voxels AS (
  SELECT 10 AS zoom, CAST(l_partkey // 64 AS INT) AS tx, CAST((l_suppkey % 64) // 16 AS INT) AS ty,
    CAST((l_orderkey + l_linenumber) % 8 AS INT) AS vz, CAST(l_suppkey % 16 AS INT) AS vy, CAST(l_partkey % 64 // 4 AS INT) AS vx,
    sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) / 16.0 AS density
  FROM lineitem GROUP BY ALL)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volume of tiles of 16 x 16 x 8 voxels at zoom 10: four high, and as many abreast as there are 64 parts.

    Densities are sixteenths, so their sums and means are exact in any order.
    """
    li = table(spark, sf_dir, "lineitem")
    amount = F.col("l_quantity").cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    keys = [
        F.lit(ZOOM).alias("zoom"), F.floor(F.col("l_partkey") / PARTS).cast("int").alias("tx"), F.floor((F.col("l_suppkey") % 64) / 16).cast("int").alias("ty"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int").alias("vz"), (F.col("l_suppkey") % 16).cast("int").alias("vy"), F.floor(F.col("l_partkey") % PARTS / 4).cast("int").alias("vx"),
    ]
    return li.groupBy(*keys).agg((F.sum(amount) / 16.0).alias("density"))



def grid_sql(nz: int, ny: int, nx: int) -> str:
    return f"""grid AS (
  SELECT g.tx, g.vz, g.vy, g.vx, coalesce(s.density, 0.0) AS density FROM
    (SELECT tx, CAST(i // {ny * nx} AS INT) AS vz, CAST((i // {nx}) % {ny} AS INT) AS vy, CAST(i % {nx} AS INT) AS vx FROM (SELECT DISTINCT CAST(p_partkey // 64 AS INT) AS tx FROM part), range({nz * ny * nx}) t(i)) g
    LEFT JOIN (SELECT tx, vz % {nz} AS vz, vy % {ny} AS vy, vx % {nx} AS vx, sum(density) AS density FROM voxels GROUP BY ALL) s USING (tx, vz, vy, vx))"""


GRID_SQL = grid_sql(8, 16, 16)


def grid(spark: SparkSession, sf_dir: str, nz: int = LEVELS, ny: int = PIXELS, nx: int = PIXELS) -> DataFrame:
    """The tiles of a column (tx) laid over each other: a dense volume for each 64 parts. What lies beyond smaller sides comes in again at their start."""
    from ..operators.volume import every_voxel

    tiles = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PARTS).cast("int").alias("tx")).distinct()
    at = [(F.col(c) % n).alias(c) for c, n in (("vz", nz), ("vy", ny), ("vx", nx))]
    sums = voxels(spark, sf_dir).groupBy("tx", *at).agg(F.sum("density").alias("density"))
    return every_voxel(tiles, nz, ny, nx).join(sums, ["tx", "vz", "vy", "vx"], "left").select("tx", "vz", "vy", "vx", F.coalesce("density", F.lit(0.0)).alias("density"))


# --- points, cells and columns -------------------------------------------------------------------

POINTS_SQL = """points AS (
  SELECT k, 9.4 + 8.0 * ((k * 7919) % 10007) / 10007.0 AS lon, 46.2 + 3.0 * ((k * 104729) % 10007) / 10007.0 AS lat
  FROM (SELECT c_custkey AS k FROM customer))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places in the region."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (9.4 + 8.0 * ((k * 7919) % 10007) / 10007.0).alias("lon"), (46.2 + 3.0 * ((k * 104729) % 10007) / 10007.0).alias("lat"))


#: Model-like cells: one per line item, all in physical ranges.
CELLS_SQL = """cells AS (
  SELECT l_orderkey * 8 + l_linenumber AS k,
    (l_partkey % 101) / 100.0 AS clc, (l_quantity - 1) * 2e-6 AS qc, (l_orderkey % 40) * 1e-6 AS qi, l_discount * 0.08 AS qv,
    215.0 + (l_partkey % 80) AS t, 20000.0 + (l_suppkey % 100) * 800.0 AS p, l_tax * 25.0 AS tke,
    (l_orderkey % 14000) + 0.5 AS height, (l_partkey % 900) * 2.0 AS ground,
    (l_orderkey % 997) * 31.7 - 9000.0 AS x, (l_partkey % 991) * 17.3 - 4000.0 AS y
  FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("k"), ((c("l_partkey") % 101) / 100.0).alias("clc"), ((c("l_quantity") - 1) * 2e-6).alias("qc"),
        ((c("l_orderkey") % 40) * 1e-6).alias("qi"), (c("l_discount") * 0.08).alias("qv"), (215.0 + (c("l_partkey") % 80)).alias("t"),
        (20000.0 + (c("l_suppkey") % 100) * 800.0).alias("p"), (c("l_tax") * 25.0).alias("tke"), ((c("l_orderkey") % 14000) + 0.5).alias("height"),
        ((c("l_partkey") % 900) * 2.0).alias("ground"), ((c("l_orderkey") % 997) * 31.7 - 9000.0).alias("x"), ((c("l_partkey") % 991) * 17.3 - 4000.0).alias("y"),
    )


#: A model column of 11 half levels for each part, 12 abreast; heights fall with the level and differ by column.
COLUMNS_SQL = """half_levels AS (
  SELECT iy, ix, CAST(l AS INT) AS level, 11000.0 * (10 - l) * (10 - l) / 100.0 + ((iy * 7 + ix * 13) % 20) * 10.0 AS hhl,
    ((iy + ix + l) % 9) * 0.3 AS tke
  FROM (SELECT CAST(p_partkey // 12 AS INT) AS iy, CAST(p_partkey % 12 AS INT) AS ix FROM part), range(11) u(l)),
full_levels AS (
  SELECT iy, ix, CAST(l AS INT) AS level, ((iy * 3 + ix * 5 + l * 7) % 11) / 10.0 AS clc, ((iy + 2 * ix + 3 * l) % 8) * 1e-5 AS qc,
    ((2 * iy + ix + l) % 5) * 1e-5 AS qi, ((iy + ix + l) % 7) * 1e-3 AS qv, 220.0 + l * 7.0 + (iy % 12) * 0.1 AS t, 25000.0 + l * 7500.0 + ix AS p
  FROM (SELECT CAST(p_partkey // 12 AS INT) AS iy, CAST(p_partkey % 12 AS INT) AS ix FROM part), range(10) u(l))"""


#: Columns abreast.
ABREAST = 12


def _levels(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / ABREAST).cast("int").alias("iy"), (k % ABREAST).cast("int").alias("ix"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"))


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the grid of columns; the count comes from the files' footers."""
    return ABREAST, -(-table(spark, sf_dir, "part").count() // ABREAST)


def half_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _levels(spark, sf_dir, 11)
    iy, ix, lv = F.col("iy"), F.col("ix"), F.col("level")
    return g.select("iy", "ix", "level", (11000.0 * (10 - lv) * (10 - lv) / 100.0 + ((iy * 7 + ix * 13) % 20) * 10.0).alias("hhl"), (((iy + ix + lv) % 9) * 0.3).alias("tke"))


def full_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _levels(spark, sf_dir, 10)
    iy, ix, lv = F.col("iy"), F.col("ix"), F.col("level")
    return g.select(
        "iy", "ix", "level", (((iy * 3 + ix * 5 + lv * 7) % 11) / 10.0).alias("clc"), (((iy + 2 * ix + 3 * lv) % 8) * 1e-5).alias("qc"), (((2 * iy + ix + lv) % 5) * 1e-5).alias("qi"),
        (((iy + ix + lv) % 7) * 1e-3).alias("qv"), (220.0 + lv * 7.0 + (iy % 12) * 0.1).alias("t"), (25000.0 + lv * 7500.0 + ix).alias("p"),
    )


def columns(spark: SparkSession, sf_dir: str, fields: tuple = ("hhl", "tke", "clc", "qc", "qi", "qv", "t", "p")) -> DataFrame:
    """The columns as arrays by level, fields scaled as stored; only `fields` of them are made."""
    from ..functions.physics import scale_stored
    from ..operators.sample import columns_of

    def long(df, names):
        return [df.select(F.lit(n).alias("var"), "level", "iy", "ix", scale_stored(n, n).alias("value")) for n in names]

    parts = long(half_levels(spark, sf_dir), [f for f in ("hhl", "tke") if f in fields]) + long(full_levels(spark, sf_dir), [f for f in ("clc", "qc", "qi", "qv", "t", "p") if f in fields])
    cube = parts[0]
    for p in parts[1:]:
        cube = cube.union(p)
    return columns_of(cube, fields)


def wind_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns with winds, as the older kernel takes them: fields as they are, p in kPa."""
    from ..operators.sample import columns_of

    iy, ix, lv = F.col("iy"), F.col("ix"), F.col("level")
    winds = {"u": ((iy + lv) % 9) * 25.0 - 80.0, "v": ((2 * ix + lv) % 7) * 20.0 - 50.0, "p": F.col("p") / 1000.0}
    half = half_levels(spark, sf_dir).withColumn("w", ((2 * iy + ix + lv) % 7) * 0.5 - 0.5)
    full = full_levels(spark, sf_dir).withColumns(winds)
    long = lambda df: df.unpivot(["level", "iy", "ix"], [c for c in df.columns if c not in ("level", "iy", "ix")], "var", "value")
    return columns_of(long(half).unionByName(long(full)), ("hhl", "clc", "qc", "qi", "qv", "t", "p", "u", "v", "tke", "w"))


SAMPLES_SQL = """samples AS (
  SELECT c_custkey AS k, ((c_custkey * 37) % 1000) / 100.0 + 0.5 AS src_x, ((c_custkey * 91) % 1000) / 1000.0 + c_custkey // 16 AS src_y,
    ((c_custkey * 53) % 1100) * 10.0 + 3.0 AS height FROM customer)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and heights to sample the columns at."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (((k * 37) % 1000) / 100.0 + 0.5).alias("src_x"), (((k * 91) % 1000) / 1000.0 + F.floor(k / 16)).alias("src_y"), (((k * 53) % 1100) * 10.0 + 3.0).alias("height"))


# --- the catalogue ---------------------------------------------------------------------------------

#: Tile sets from orders: a run every three hours and steps up to 45, so that targets meet; every further 1,500 orders have
#: runs of three days before. Each 1,500 orders have twelve maintenance jobs of their own, and some jobs have no active sets.
TILESETS_SQL = """tilesets AS (
  SELECT o_orderkey AS seq, strftime(run_ts, '%Y%m%d%H') || '_' || lpad(CAST(step AS VARCHAR), 3, '0') AS folder, strftime(run_ts, '%Y%m%d%H') AS run_str,
    step, strftime(run_ts + step * INTERVAL 1 HOUR, '%Y%m%d%H') AS target_str, run_ts, run_ts + step * INTERVAL 1 HOUR AS target_ts,
    CASE WHEN o_custkey % 3 > 0 AND o_custkey % 10 < 4 AND o_orderkey % 5 < 2 THEN 'ready' WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 5 = 1 THEN 'fetching' WHEN o_orderkey % 5 = 2 THEN 'failed' ELSE 'ready' END AS status,
    CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 10 + 12 * (o_orderkey // 1500) END AS maintenance_id, o_orderkey % 7 > 2 AS timed
  FROM (SELECT *, CAST(o_custkey % 16 * 3 AS INT) AS step,
    TIMESTAMP '1995-06-13 00:00:00' + ((o_orderkey % 24 - 24 * (o_orderkey // 1500)) * 3) * INTERVAL 1 HOUR AS run_ts FROM orders))"""


#: Orders of three days of runs.
ERA = 1500


def tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    o = table(spark, sf_dir, "orders")
    era = F.floor(F.col("o_orderkey") / ERA)
    run = F.lit("1995-06-13 00:00:00").cast("timestamp") + F.make_dt_interval(hours=((F.col("o_orderkey") % 24 - 24 * era) * 3).cast("int"))
    over = (F.col("o_custkey") % 3 > 0) & (F.col("o_custkey") % 10 < 4) & (F.col("o_orderkey") % 5 < 2)
    status = F.when(over, "ready").when(F.col("o_orderkey") % 5 == 0, "pending").when(F.col("o_orderkey") % 5 == 1, "fetching").when(F.col("o_orderkey") % 5 == 2, "failed").otherwise("ready")
    named = o.withColumn("run_ts", run).withColumn("step", (F.col("o_custkey") % 16 * 3).cast("int"))
    target = text.target_time("run_ts", "step")
    return named.select(
        F.col("o_orderkey").alias("seq"), text.folder(text.run_text("run_ts"), "step").alias("folder"), text.run_text("run_ts").alias("run_str"), "step",
        text.run_text(target).alias("target_str"), "run_ts", target.alias("target_ts"), status.alias("status"), F.col("o_totalprice").cast("long").alias("size"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 10 + 12 * era).alias("maintenance_id"),
        F.when(F.col("o_orderkey") % 7 > 2, F.create_map(F.lit("download"), F.lit(1.0))).alias("step_timings"),
    )


#: Each folder once, as the catalogue's key demands: the first inserted.
CATALOG_SQL = TILESETS_SQL + """,
catalog AS (SELECT * FROM tilesets QUALIFY row_number() OVER (PARTITION BY folder ORDER BY seq) = 1)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tilesets(spark, sf_dir)
    cols = [c for c in rows.columns if c != "folder"]
    return rows.groupBy("folder").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("folder", *[F.col(f"r.{c}").alias(c) for c in cols])


#: Folders on disk, one per event user and hour; every further 1,000 events have runs of three days before.
DISK_SQL = """disk AS (
  SELECT strftime(run_ts, '%Y%m%d%H') || '_' || lpad(CAST(step AS VARCHAR), 3, '0') AS folder, run_ts, step, max(event_id) % 3 > 0 AS ready
  FROM (SELECT event_id, CAST(user_id % 16 * 3 AS INT) AS step, TIMESTAMP '1995-06-13 00:00:00' + ((event_id % 24 - 24 * (event_id // 1000)) * 3) * INTERVAL 1 HOUR AS run_ts FROM events)
  GROUP BY ALL)"""


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    e = table(spark, sf_dir, "events")
    run = F.lit("1995-06-13 00:00:00").cast("timestamp") + F.make_dt_interval(hours=((F.col("event_id") % 24 - 24 * F.floor(F.col("event_id") / 1000)) * 3).cast("int"))
    named = e.select("event_id", run.alias("run_ts"), (F.col("user_id") % 16 * 3).cast("int").alias("step"))
    folders = named.groupBy("run_ts", "step").agg((F.max("event_id") % 3 > 0).alias("ready"))
    return folders.select(text.folder(text.run_text("run_ts"), "step").alias("folder"), "run_ts", "step", "ready")


#: Retention: keep the far past at noon, fetch and purge around today, only fetch tomorrow.
POLICY = [(0, -1, [0, 12], "purge_only"), (1, 1, [0, 6, 12, 18], "fetch_and_purge"), (2, 2, [0, 3, 6, 9, 12, 15, 18, 21], "fetch_only")]
POLICY_SQL = """policy AS (
  SELECT * FROM (VALUES (0, -1, [0, 12], 'purge_only'), (1, 1, [0, 6, 12, 18], 'fetch_and_purge'), (2, 2, [0, 3, 6, 9, 12, 15, 18, 21], 'fetch_only')) v(prio, before, hours, mode))"""


def policy(spark: SparkSession) -> DataFrame:
    from ..schemas import POLICY as SCHEMA

    return spark.createDataFrame(POLICY, SCHEMA)
