"""A table of encoded tiles, partitioned by tile set, zoom and column, so that a request reads one folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import TILE_PATH

SCHEMA = "row long, content binary, folder string, zoom int, x long"
_KEYS = ["folder", "zoom", "x"]


def save(tiles: DataFrame, path: str, spread: int = 1) -> None:
    """Adds tiles (folder, zoom, x, row, content): each folder, zoom and x that they touch is replaced as a whole, all others stay.

    One of them is written by `spread` tasks, so it has as many files; rows are sorted in them, so that
    their statistics tell which row group holds a tile.
    """
    part = F.pmod(F.hash("row"), F.lit(spread))
    rows = tiles.select(F.col("row").cast("long").alias("row"), "content", "folder", F.col("zoom").cast("int").alias("zoom"), F.col("x").cast("long").alias("x"))
    dealt = rows.repartition(*_KEYS, part).sortWithinPartitions(*_KEYS, "row")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_KEYS).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def one(spark: SparkSession, path: str, request: str) -> DataFrame:
    """The content of one requested path, no row if there is none or the path isn't a tile's. Only its folder is listed and read."""
    m = re.fullmatch(TILE_PATH, request)
    folder, zoom, x, row = (m[1], *map(int, m.groups()[1:])) if m else ("", -1, -1, -1)
    return load(spark, path).filter((F.col("folder") == folder) & (F.col("zoom") == zoom) & (F.col("x") == x) & (F.col("row") == row)).select(F.lit(request).alias("path"), "content")


def many(requests: DataFrame, path: str) -> DataFrame:
    """Requested paths (path) with their content, null for those that aren't there or aren't tiles'. The folders asked for are found first, and only those are read."""
    part = lambda i: F.regexp_extract("path", f"^{TILE_PATH}$", i)
    asked = requests.select("path").distinct().select("path", part(1).alias("folder"), part(2).try_cast("int").alias("zoom"), part(3).try_cast("long").alias("x"), part(4).try_cast("long").alias("row"))
    found = load(requests.sparkSession, path).join(asked.filter("row IS NOT NULL"), [*_KEYS, "row"]).select("path", "content")
    return requests.select("path").join(found, "path", "left")
