"""Tiles of a pyramid as arrays, some at a time: mips of sparse tiles, their BC4 payloads, and texels read again."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import ship
from ..storage import written
from . import bc4, volume

TILE = ["zoom", "tx", "ty"]


#: Values of tiles that are made or read at once, and at least one tile.
AT_ONCE = 1 << 18


def by_tile(voxels: DataFrame, nz: int, pixels: int, run, schema, value: str = "density") -> DataFrame:
    """Record batches that `run` makes of some tiles at once: it gets TILE as rows of whole numbers, and values (tiles, nz, pixels, pixels).

    Absent voxels are 0. A partition is in order of tiles, so a task holds one batch of voxels and AT_ONCE values,
    however many tiles it has.
    """
    ship(voxels.sparkSession)
    size = nz * pixels * pixels
    most = max(1, AT_ONCE // size)
    rows = voxels.select(*TILE, ((F.col("vz") * pixels + F.col("vy")) * pixels + F.col("vx")).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))

    def stream(batches):
        names, whole = [], np.zeros((most, size))
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TILE], 1)
            place, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_v"))
            ends = np.flatnonzero(np.append((np.diff(keys, axis=0) != 0).any(1), len(keys) > 0)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                if not names or (keys[a] != names[-1]).any():
                    if len(names) == most:
                        yield from run(np.array(names), whole.reshape(most, nz, pixels, pixels))
                        names, whole = [], np.zeros((most, size))
                    names.append(keys[a])
                whole[len(names) - 1, place[a:b]] = values[a:b]
        if names:
            yield from run(np.array(names), whole[: len(names)].reshape(-1, nz, pixels, pixels))

    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(stream, schema)


def tile_mips(voxels: DataFrame, nz: int, pixels: int, least: int = 4) -> list[tuple[tuple[int, int, int], DataFrame]]:
    """(size, voxels) of each mip of all tiles, absent voxels 0: means of 2 x 2 x 2, an odd last layer cut off. Each is made from the one before, which is written."""
    sizes = volume.mip_sizes(nz, pixels, pixels, least)
    out = [voxels.select(*TILE, "vz", "vy", "vx", "density")]
    for large, small in zip(sizes, sizes[1:], strict=False):
        halved = [c for c, a, b in zip(("vz", "vy", "vx"), large, small, strict=True) if b < a]
        whole = reduce(lambda df, ca: df.filter(F.col(ca[0]) < ca[1] // 2 * 2) if ca[0] in halved else df, zip(("vz", "vy", "vx"), large, strict=True), out[-1])
        at = [(F.shiftright(c, 1) if c in halved else F.col(c)).alias(c) for c in ("vz", "vy", "vx")]
        out.append(written(whole.groupBy(*TILE, *at).agg((F.sum("density") / 2 ** len(halved)).alias("density")), "mip"))
    return list(zip(sizes, out, strict=True))


def mips_of(values: np.ndarray, least: int = 4) -> list[np.ndarray]:
    """All mips of volumes (volumes, nz, ny, nx), largest first: means of 2 x 2 x 2, an odd last layer cut off, sides of 1 stay."""
    sizes = volume.mip_sizes(*values.shape[1:], least)
    out = [values]
    for large, small in zip(sizes, sizes[1:], strict=False):
        v = out[-1]
        for axis, (a, b) in enumerate(zip(large, small, strict=True), 1):
            if b < a:
                v = v.take(range(0, 2 * b, 2), axis) + v.take(range(1, 2 * b, 2), axis)
        out.append(v / 2 ** sum(b < a for a, b in zip(large, small, strict=True)))
    return out


def texels(tiles: DataFrame, nz: int, pixels: int, least: int = 4) -> DataFrame:
    """The values 0..1 of encoded tiles: their other columns, level, vz, vy, vx, value. A mip of some tiles is decoded at a time."""
    ship(tiles.sparkSession)
    sizes = volume.mip_sizes(nz, pixels, pixels, least)
    most = max(1, AT_ONCE // (nz * pixels * pixels))
    rest = [c for c in tiles.columns if c != "mips"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                mips = part.column("mips").to_pylist()
                for level, size in enumerate(sizes):
                    values = bc4.decode_volumes(np.frombuffer(b"".join(m[level] for m in mips), np.uint8), size).reshape(len(mips), -1)
                    row = pa.array(np.repeat(np.arange(len(mips)), values.shape[1]))
                    z, y, x = (pa.array(np.tile(a.ravel(), len(mips)), pa.int32()) for a in np.indices(size))
                    yield pa.RecordBatch.from_pydict({c: part.column(c).take(row) for c in rest} | {"level": pa.array(np.full(len(row), level), pa.int32()), "vz": z, "vy": y, "vx": x, "value": pa.array(values.ravel())})

    whole = [StructField(c, IntegerType()) for c in ("level", "vz", "vy", "vx")]
    return tiles.select(*rest, "mips").mapInArrow(run, StructType([tiles.schema[c] for c in rest] + whole + [StructField("value", DoubleType())]))


def encoded_tiles(voxels: DataFrame, nz: int, pixels: int, least: int = 4, most: float = bc4.MAX_DENSITY) -> DataFrame:
    """One row per tile with `mips`, the BC4 payload of each mip, largest first. Lines count from the south.

    Voxels are sent once, to their tile; its mips are made and encoded there.
    """

    def run(names, values):
        mips = [bc4.encode_volumes(np.clip(m / most, 0.0, 1.0)) for m in mips_of(values[:, :, ::-1], least)]
        payloads = pa.array([[m[i].tobytes() for m in mips] for i in range(len(names))], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([*[pa.array(names[:, i], pa.int32()) for i in range(3)], payloads], [*TILE, "mips"])

    return by_tile(voxels, nz, pixels, run, "zoom int, tx int, ty int, mips array<binary>")
