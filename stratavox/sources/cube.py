"""Model fields: decoded messages to the long cube, and the cube's layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import level_of


def read(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """The long cube (var, level, iy, ix, value) from Parquet; only the variables asked for are read."""
    cube = spark.read.parquet(path)
    return cube.filter(F.col("var").isin(*variables)) if variables else cube


def stacked(fields: DataFrame) -> DataFrame:
    """Decoded 2-D fields (file, iy, ix, value) as a cube: variable and level come from the file's name; files without a level are left out."""
    name = F.element_at(F.split("file", "/"), -1)
    named = fields.select(F.regexp_extract(name, r"^([a-z0-9]+?)_\d+\.", 1).alias("var"), level_of(name).alias("level"), "iy", "ix", F.col("value").cast("float").alias("value"))
    return named.filter(F.col("level").isNotNull() & (F.col("var") != ""))


def complete(cube: DataFrame, catalog: DataFrame, variables: list[str], cells: DataFrame) -> DataFrame:
    """The cube with every (variable, level, cell): what is missing is 0. `cells` has iy, ix."""
    wanted = catalog.filter(F.col("name").isin(*variables)).select(F.col("name").alias("var"), F.explode("levels").alias("level"))
    grid = cells.join(F.broadcast(wanted))
    return grid.join(cube, ["var", "level", "iy", "ix"], "left").select("var", "level", "iy", "ix", F.coalesce("value", F.lit(0.0).cast("float")).alias("value"))


def slots(cube: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cube with `z`, the place of its level in the variable's list; the catalogue has 18 rows and is broadcast."""
    places = catalog.select(F.col("name").alias("var"), F.posexplode("levels").alias("z", "level"))
    return cube.join(F.broadcast(places), ["var", "level"])


def by_order(files: DataFrame) -> DataFrame:
    """Files (var, file, level) numbered by level within their variable, as viewers stack them."""
    from pyspark.sql import Window

    return files.withColumn("z", F.row_number().over(Window.partitionBy("var").orderBy("level")) - 1)


def levels_by_variable(files: DataFrame) -> DataFrame:
    """A map of level to file for each variable, of files (file)."""
    name = F.element_at(F.split("file", "/"), -1)
    named = files.select(F.regexp_extract(name, r"^([a-z0-9]+?)_\d+\.", 1).alias("var"), level_of(name).alias("level"), "file").filter("level is not null")
    return named.groupBy("var").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "file")))).alias("files"))


def wide(cube: DataFrame, variables: list[str]) -> DataFrame:
    """One column per variable."""
    return cube.groupBy("level", "iy", "ix").pivot("var", variables).agg(F.first("value"))


def cropped(cube: DataFrame, lat: DataFrame, lon: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """The cube inside a box of coordinates. The axes hold one row per grid line and are broadcast."""
    rows = lat.filter(F.col("lat").between(south, north)).select("iy")
    cols = lon.filter(F.col("lon").between(west, east)).select("ix")
    return cube.join(F.broadcast(rows), "iy", "left_semi").join(F.broadcast(cols), "ix", "left_semi")
