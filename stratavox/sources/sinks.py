"""File sinks: tasks write their rows' content as files; a file gets its name when it is whole.

Raw tiles, containers of pyramid tiles and of shadow maps are composed here from volumes. Pyramids are
committed as a whole by `tile_store`.
"""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lod, stencil, volume
from ..session import ship
from ..storage import written
from . import ktx2, raw_tiles, tile_store

_WRITTEN = "path string, bytes long"


def write_files(rows: DataFrame, uri: str) -> DataFrame:
    """Writes `content` of each row to `path` below the folder `uri`; one row (path, bytes) per file. Nothing is written before an action.

    A file of that name is replaced. A task that is run again writes the same files again.
    """
    ship(rows.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1), strict=True):
                at = f"{root}/{name}"
                part = f"{root}/_part-{uuid.uuid4().hex}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, at)
                sizes.append(content.as_buffer().size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select("path", "content").mapInArrow(run, _WRITTEN)


def raw_tile_files(voxels: DataFrame, uri: str, nz: int, pixels: int, resolution: tuple[float, float, float]) -> DataFrame:
    """Writes `tile_{zoom}_{x}_{y}.raw.zst` for each tile: half floats behind the header of `resolution` and place."""
    head = dict(zip(raw_tiles.FIELDS[:3], resolution, strict=True))

    def packed(names, values):
        paths = [f"tile_{z}_{x}_{y}.raw.zst" for z, x, y in names.tolist()]
        contents = [raw_tiles.encode(head | dict(zip(raw_tiles.FIELDS[3:], n, strict=True)), v) for n, v in zip(names.tolist(), values, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])

    return write_files(lod.by_tile(voxels, nz, pixels, packed, "path string, content binary"), uri)


def lod_tile_files(voxels: DataFrame, uri: str, nz: int, pixels: int, resolution: tuple[float, float, float], leaf_zoom: int, most: float = 32.0, least: int = 4, mode: str = "append") -> None:
    """Writes a container `{zoom}/{x}/{row}.ktx2` for each tile of a pyramid, all or none: rows count from the south, lines too.

    BC4 blocks with all mips down to a side of `least`, compressed; 1 stands for `most`. `resolution`
    is metres of a voxel at `leaf_zoom`; x and y double with each zoom above.
    """
    tiles = lod.encoded_tiles(voxels, nz, pixels, least, most).withColumn("row", geo.flip_row("ty", "zoom"))
    wider = F.pow(F.lit(2.0), F.lit(leaf_zoom) - F.col("zoom"))
    values = {
        "val_scale": F.lit(float(most)), "phys_res_x": resolution[0] * wider, "phys_res_y": resolution[1] * wider, "phys_res_z": F.lit(float(resolution[2])),
        "tile_z": F.col("zoom"), "tile_x": F.col("tx"), "tile_y": F.col("row"), "compression": F.lit("BC4"),
    }
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    built = ktx2.containers(tiles.select("zoom", "tx", "row", "mips", pairs.alias("metadata")), "BC4_UNORM_BLOCK", pixels, pixels, nz)
    tile_store.save(built.select(F.format_string("%d/%d/%d.ktx2", "zoom", "tx", "row").alias("path"), "content"), uri, mode)


def blurred_strip(strip: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of a strip that already has the lines it needs above and below; columns are reflected at the ends. The lines needed are cut off."""
    taps = stencil.gauss_weights(sigma) if sigma > 0 else [(0, 1.0)]
    r = taps[-1][0]
    high = strip.shape[0] - 2 * r
    down = sum(w * strip[r + o : r + o + high] for o, w in taps)
    wide = down.shape[1]
    at = np.arange(-r, wide + r) % (2 * wide)
    held = down[:, np.minimum(at, 2 * wide - 1 - at)]
    return sum(w * held[:, r + o : r + o + wide] for o, w in taps)


def shadow_map_file(voxels: DataFrame, uri: str, name: str, nz: int, pixels: int, zoom: int, region: tuple[float, float, float, float], threshold: float = 2.0, sharpness: float = 4.0, sigma: float = 1.0, band_pixels: int = 1 << 22) -> DataFrame:
    """Writes the shadow map of a region (west, south, east, north) as one flat container of half floats; one row (path, bytes).

    The canvas covers all tiles of the region; a tile without any voxel is 0, a column without is lit.
    It is blurred, then cut to the region. Each task makes a band of about `band_pixels`, blurs it with
    the lines around it and writes it as a compressed part; one last task puts the parts behind the
    header, as they are. The parts go when it is done.
    """
    spark = voxels.sparkSession
    ship(spark)
    west, south, east, north = region
    if west >= east or south >= north:
        raise ValueError(f"the region {region} has no pixel")
    box = spark.range(1).select(geo.tile_range(F.lit(west), F.lit(south), F.lit(east), F.lit(north), F.lit(zoom)).alias("t"), geo.tile_width(F.lit(zoom)).alias("w"), *[f(F.lit(v)).alias(c) for c, f, v in (("l", geo.merc_x, west), ("r", geo.merc_x, east), ("b", geo.merc_y, south), ("u", geo.merc_y, north))])
    tx0, ty0, tx1, ty1 = (F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1"))
    corner = geo.tile_bounds(tx0, ty0, F.lit(zoom))
    sized = box.withColumn("c", corner).select("*", (F.col("w") / pixels).alias("res"), ((tx1 - tx0 + 1) * pixels).alias("wide"), ((ty1 - ty0 + 1) * pixels).alias("high")).first()
    wide, high, t = sized.wide, sized.high, sized.t
    cut = spark.range(1).select(geo.crop_pixels(*(F.lit(sized[c]) for c in ("l", "b", "r", "u")), F.lit(sized.c.left), F.lit(sized.c.top), F.lit(sized.res), wide, high).alias("p"))
    cut = cut.select("p.*", geo.pixel_metres("p.px0", "p.py0", F.lit(sized.c.left), F.lit(sized.c.top), F.lit(sized.res)).alias("ul"), geo.pixel_metres("p.px1", "p.py1", F.lit(sized.c.left), F.lit(sized.c.top), F.lit(sized.res)).alias("lr")).first()
    (x0, x1), (y0, y1) = (cut.px0, cut.px1), (cut.py0, cut.py1)
    reach = stencil.gauss_weights(sigma)[-1][0] if sigma > 0 else 0
    lines = max(1, band_pixels // wide)
    n = -(-(y1 - y0) // lines)

    inside = voxels.filter((F.col("zoom") == zoom) & F.col("tx").between(t.x0, t.x1) & F.col("ty").between(t.y0, t.y1))
    shade = volume.shadow_map(inside, nz, threshold, sharpness).select(F.col("tx"), F.col("ty"), F.struct((F.col("vy") * pixels + F.col("vx")).alias("i"), F.col("shadow").alias("v")).alias("c"))

    @F.pandas_udf("binary")
    def lit(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for at, v in zip(places, values, strict=True):
            tile = np.ones(pixels * pixels, "<f2")
            tile[np.asarray(at, np.int64)] = np.asarray(v, np.float64)
            out.append(tile.tobytes())
        return pd.Series(out)

    tiles = shade.groupBy("tx", "ty").agg(F.collect_list("c").alias("c")).select("tx", "ty", lit("c.i", "c.v").alias("texels"))
    # A tile goes to each band that has one of its lines, or needs one for the blur; reflected lines are within reach of the edge too.
    top = (F.col("ty") - t.y0) * pixels
    first, last = (F.floor((top - reach - y0) / lines), F.floor((top + pixels - 1 + reach - y0) / lines))
    near = tiles.filter((last >= 0) & (first < n))
    sent = near.select("*", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1)))).alias("band"))
    every = spark.range(n).select(F.lit(None).cast("int").alias("tx"), F.lit(None).cast("int").alias("ty"), F.lit(None).cast("binary").alias("texels"), F.col("id").alias("band"))
    parts_at = f"{uri.rstrip('/')}/_parts-{uuid.uuid4().hex}"

    def band(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        low, up = y0 + b * lines, min(y0 + (b + 1) * lines, y1)
        want = np.arange(low - reach, up + reach) % (2 * high)
        want = np.minimum(want, 2 * high - 1 - want)
        start, stop = want.min(), want.max() + 1
        canvas = np.zeros((stop - start, wide))
        for tx, ty, texels in zip(rows["tx"], rows["ty"], rows["texels"], strict=True):
            if texels is None:
                continue
            tile = np.frombuffer(texels, "<f2").reshape(pixels, pixels)
            y, x = (int(ty) - t.y0) * pixels, (int(tx) - t.x0) * pixels
            a, z = max(start, y), min(stop, y + pixels)
            if a < z:
                canvas[a - start : z - start, x : x + pixels] = tile[a - y : z - y]
        raw = blurred_strip(canvas[want - start], sigma)[:, x0:x1].astype("<f2").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(raw)
        store, root = fs.FileSystem.from_uri(parts_at)
        store.create_dir(root, recursive=True)
        part = f"{root}/{b}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(packed)
        return pd.DataFrame([(b, part, len(packed), len(raw))], columns=["band", "part", "packed", "full"])

    parts = sent.select("tx", "ty", "texels", F.col("band").cast("long")).unionByName(every).groupBy("band").applyInPandas(band, "band long, part string, packed long, full long")
    pairs = {"sharpness": sharpness, "min_x": cut.ul.x, "max_y": cut.ul.y, "max_x": cut.lr.x, "min_y": cut.lr.y}

    def join(batches):
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["band"])
        if not found:
            return
        store, root = fs.FileSystem.from_uri(uri)
        head, pads = ktx2.preamble("R16_SFLOAT", (x1 - x0, y1 - y0, 1), [(sum(r["packed"] for r in found), sum(r["full"] for r in found))], pairs, flat=True, compress=True)
        made = f"{root}/_part-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        size = 0
        with store.open_output_stream(made) as out:
            out.write(head + b"\0" * pads[0])
            for r in found:
                with store.open_input_stream(r["part"]) as piece:
                    while chunk := piece.read(1 << 20):
                        out.write(chunk)
            size = out.tell()
        store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
        store.move(made, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "bytes"])

    done = written(parts, "bands").repartition(1).mapInArrow(join, _WRITTEN)
    out = written(done, "shadow")
    store, root = fs.FileSystem.from_uri(parts_at)
    store.delete_dir(root)
    return out
