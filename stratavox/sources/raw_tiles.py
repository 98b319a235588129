"""Raw tiles: a zstd stream of a length, a JSON header and half floats."""

from __future__ import annotations

import json

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tile_name
from ..session import ship

#: Compression level, and the header's fields.
LEVEL, FIELDS = 3, ("phys_res_x", "phys_res_y", "phys_res_z", "tile_z", "tile_x", "tile_y")
_CONTENT = "path string, phys_res_x double, phys_res_y double, phys_res_z double, zoom int, tx int, ty int, density array<float>"


def encode(header: dict, density: np.ndarray) -> bytes:
    text = json.dumps(header).encode()
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(text).to_bytes(4, "little") + text + density.astype("<f2").tobytes())


def decode(content: bytes) -> tuple[dict, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    n = int.from_bytes(raw[:4], "little")
    return json.loads(raw[4 : 4 + n]), np.frombuffer(raw, "<f2", offset=4 + n)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw tiles under a path, one row each, voxels in order z, y, x."""
    import pandas as pd

    ship(spark)
    columns = [x.split()[0] for x in _CONTENT.split(", ")]

    def parse(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                head, values = decode(bytes(content))
                rows.append((name, *(head[f] for f in FIELDS), values.astype(np.float32)))
            yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.raw.zst").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(parse, _CONTENT)


def voxels(tiles: DataFrame, ny: int, nx: int) -> DataFrame:
    """Tiles as long voxels."""
    out = tiles.select("zoom", "tx", "ty", F.posexplode("density").alias("i", "density"))
    return out.select("zoom", "tx", "ty", F.floor(F.col("i") / (ny * nx)).cast("int").alias("vz"), (F.floor(F.col("i") / nx) % ny).cast("int").alias("vy"), (F.col("i") % nx).alias("vx"), "density")


def leaves(spark: SparkSession, path: str, zoom: int) -> DataFrame:
    """Tiles of one zoom by the names of files under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.withColumn("t", tile_name("path")).filter(F.col("t.zoom") == zoom).select("t.x", "t.y").distinct()
