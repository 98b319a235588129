"""BC4 blocks: 4 x 4 texels in two end points and sixteen 3-bit indices, natively on arrays and as kernels over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.noise import _let
from ..session import ship

#: Step of the end point search, and the density that becomes 1.
STEP, MAX_DENSITY = 0.004, 32.0
#: Steps by which a pair of end points leaves the extremes, down and up, in the order tried.
PAIRS = ((0, 0), (1, -1), (1, 0), (0, -1), (-1, 1))


def normalised(density, most: float = MAX_DENSITY) -> Column:
    return F.least(F.greatest(col(density) / most, F.lit(0.0)), F.lit(1.0))


def palette_index(v: Column, low: Column, high: Column) -> Column:
    """Index of the nearest of eight values between low and high: 0 is high, 1 is low, 2..7 step down between."""
    at = 7 - F.rint(F.least(F.greatest(F.try_divide(v - low, high - low), F.lit(0.0)), F.lit(1.0)) * 7.0).cast("int")
    return F.when(high <= low, 0).when(at == 0, 0).when(at == 7, 1).otherwise(at + 1)


def palette_value(i: Column, low: Column, high: Column) -> Column:
    return F.when(i == 0, high).when(i == 1, low).otherwise(low + (high - low) * ((8 - i) / 7.0))


def _error(pixels: Column, low: Column, high: Column) -> Column:
    def add(total, v):
        d = v - palette_value(palette_index(v, low, high), low, high)
        return total + d * d

    return F.aggregate(pixels, F.lit(0.0), add)


def end_points(pixels: Column) -> Column:
    """Struct of low, high: the best of five pairs around the extremes; the first of equals, to twelve decimals, wins."""

    def search(ends):
        pairs = []
        for i, (down, up) in enumerate(PAIRS):
            low = F.least(F.greatest(ends["low"] + STEP * down, F.lit(0.0)), F.lit(1.0))
            high = F.least(F.greatest(ends["high"] + STEP * up, F.lit(0.0)), F.lit(1.0))
            high = F.when(low >= high, low + 0.0001).otherwise(high)
            pairs.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
        scored = F.transform(F.array(*pairs), lambda p: F.struct(F.round(_error(pixels, p["low"], p["high"]), 12).alias("err"), p["i"].alias("i"), p["low"].alias("low"), p["high"].alias("high")))
        return F.array_min(scored)

    ends = F.struct(F.least(F.array_min(pixels), F.lit(1.0)).alias("low"), F.greatest(F.array_max(pixels), F.lit(0.0)).alias("high"))
    return _let(ends, search)


def encode(pixels) -> Column:
    """Struct of r0, r1, indices, bits (48-bit) for an array of 16 values in 0..1.

    A block with any value above 0 never becomes all zeros, and such a value never takes the index of
    an end point that is 0.
    """
    pixels = col(pixels)

    def quantised(best):
        r0, r1 = F.rint(best["high"] * 255.0).cast("int"), F.rint(best["low"] * 255.0).cast("int")
        lost = (F.array_max(pixels) > 0) & (r0 == 0)
        return F.struct(F.when(lost, 1).otherwise(r0).alias("r0"), F.when(lost, 0).otherwise(r1).alias("r1"))

    def packed(r):
        def index(v):
            i = palette_index(v, r["r1"] / 255.0, r["r0"] / 255.0)
            kept = F.when((v > 0) & (i == 1) & (r["r1"] == 0), 7).otherwise(i)
            return F.when(r["r0"] > r["r1"], kept).otherwise(0)

        return _let(F.transform(pixels, index), lambda n: F.struct(r["r0"].alias("r0"), r["r1"].alias("r1"), n.alias("indices"), _bits(n).alias("bits")))

    return _let(_let(end_points(pixels), quantised), packed)


def _bits(indices: Column) -> Column:
    """Sixteen 3-bit values, the first lowest."""
    total = F.lit(0).cast("long")
    for i in range(16):
        total = total.bitwiseOR(F.shiftleft(F.element_at(indices, i + 1).cast("long"), 3 * i))
    return total


def block_bytes(block) -> Column:
    """The eight bytes of an encoded block."""
    block = col(block)
    whole = block["r0"].cast("long").bitwiseOR(F.shiftleft(block["r1"].cast("long"), 8)).bitwiseOR(F.shiftleft(block["bits"], 16))
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(whole, 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(8)]))


def from_bytes(block) -> Column:
    """Struct of r0, r1, bits of eight bytes."""
    h = F.hex(col(block))
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    bits = F.lit(0).cast("long")
    for i in range(6):
        bits = bits.bitwiseOR(F.shiftleft(byte(i + 2), 8 * i))
    return F.struct(byte(0).cast("int").alias("r0"), byte(1).cast("int").alias("r1"), bits.alias("bits"))


def decode(r0, r1, bits) -> Column:
    """The 16 values: eight steps between the ends if r0 > r1, else six and the constants 0 and 1."""
    r0, r1, bits = col(r0), col(r1), col(bits)
    high, low = r0 / 255.0, r1 / 255.0

    def at(k):
        i = F.floor(bits / F.pow(F.lit(2.0), k * 3)).cast("long").bitwiseAND(F.lit(7).cast("long")).cast("int")
        six = F.when(i == 6, 0.0).when(i == 7, 1.0).when(i == 0, high).when(i == 1, low).otherwise(high + (low - high) * ((i - 1) / 5.0))
        return F.when(r0 > r1, palette_value(i, low, high)).otherwise(six)

    return F.transform(F.sequence(F.lit(0), F.lit(15)), at)


def encode_blocks(pixels: np.ndarray) -> np.ndarray:
    """What `encode` and `block_bytes` give, for rows of 16 values at once: rows of eight bytes."""
    down, up = (STEP * np.array(side, np.float64) for side in zip(*PAIRS, strict=True))
    lows = np.clip(np.minimum(pixels.min(1), 1.0)[:, None] + down, 0.0, 1.0)
    highs = np.clip(np.maximum(pixels.max(1), 0.0)[:, None] + up, 0.0, 1.0)
    highs = np.where(lows >= highs, lows + 0.0001, highs)
    errors = np.zeros(lows.shape)
    for v in pixels.T[:, :, None]:
        at = _nearest(v, lows, highs)
        errors += (v - np.where(at == 0, highs, np.where(at == 1, lows, lows + (highs - lows) * ((8 - at) / 7.0)))) ** 2
    best = (np.arange(len(pixels)), np.round(errors, 12).argmin(1))
    r0, r1 = np.rint(highs[best] * 255.0).astype(np.int64), np.rint(lows[best] * 255.0).astype(np.int64)
    lost = (pixels.max(1) > 0) & (r0 == 0)
    r0, r1 = np.where(lost, 1, r0)[:, None], np.where(lost, 0, r1)[:, None]
    at = _nearest(pixels, r1 / 255.0, r0 / 255.0)
    at = np.where(r0 > r1, np.where((pixels > 0) & (at == 1) & (r1 == 0), 7, at), 0)
    whole = r0[:, 0] | r1[:, 0] << 8 | (at << 3 * np.arange(16)).sum(1) << 16
    return whole.astype("<i8").view(np.uint8).reshape(-1, 8)


def _nearest(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """`palette_index` on arrays."""
    wide = np.where(high > low, high - low, 1.0)
    at = 7 - np.rint(np.clip((v - low) / wide, 0.0, 1.0) * 7.0).astype(np.int64)
    return np.where((high <= low) | (at == 0), 0, np.where(at == 7, 1, at + 1))


def decode_blocks(content: np.ndarray) -> np.ndarray:
    """What `decode` gives, for rows of eight bytes at once: rows of 16 values."""
    whole = np.ascontiguousarray(content).view("<u8").reshape(-1, 1)
    high, low = (whole & np.uint64(255)) / 255.0, (whole >> np.uint64(8) & np.uint64(255)) / 255.0
    at = (whole >> np.uint64(16) + np.arange(16, dtype=np.uint64) * np.uint64(3) & np.uint64(7)).astype(np.int64)
    ends = np.where(at == 0, high, low)
    eight = np.where(at < 2, ends, low + (high - low) * ((8 - at) / 7.0))
    six = np.where(at < 2, ends, np.where(at > 5, at - 6.0, high + (low - high) * ((at - 1) / 5.0)))
    return np.where(high > low, eight, six)


def encode_plane(plane: np.ndarray) -> bytes:
    """The blocks of a plane of values in 0..1, line by line; sides are padded with their edge."""
    grown = np.pad(plane, [(0, -n % 4) for n in plane.shape], "edge")
    high, wide = (n // 4 for n in grown.shape)
    return encode_blocks(grown.reshape(high, 4, wide, 4).swapaxes(1, 2).reshape(-1, 16)).tobytes()


def encode_volumes(values: np.ndarray) -> np.ndarray:
    """Planes of many volumes (volumes, nz, ny, nx) with values in 0..1 as rows of bytes, a row for each volume."""
    grown = np.pad(values, [(0, 0), (0, 0), *((0, -n % 4) for n in values.shape[2:])], "edge")
    n, nz, high, wide = grown.shape
    return encode_blocks(grown.reshape(n * nz, high // 4, 4, wide // 4, 4).swapaxes(2, 3).reshape(-1, 16)).reshape(n, -1)


def decode_volumes(content: np.ndarray, size: tuple[int, int, int]) -> np.ndarray:
    """Rows of bytes as volumes (volumes, nz, ny, nx)."""
    nz, ny, nx = size
    high, wide = -(-ny // 4), -(-nx // 4)
    values = decode_blocks(content.reshape(-1, 8)).reshape(-1, nz, high, wide, 4, 4).swapaxes(3, 4)
    return values.reshape(-1, nz, high * 4, wide * 4)[:, :, :ny, :nx]


def decode_plane(content: bytes, wide: int) -> np.ndarray:
    """The values of a plane whose lines hold `wide` blocks."""
    values = decode_blocks(np.frombuffer(content, np.uint8).reshape(-1, 8))
    return values.reshape(-1, wide, 4, 4).swapaxes(1, 2).reshape(-1, wide * 4)


def padded(texels: DataFrame, height: int, width: int) -> DataFrame:
    """Texels (vy, vx) with their last line and column repeated up to sides that blocks divide."""
    h4, w4 = -(-height // 4) * 4, -(-width // 4) * 4
    for axis, size, full in (("vy", height, h4), ("vx", width, w4)):
        if full > size:
            edge = texels.filter(F.col(axis) == size - 1).withColumn(axis, F.explode(F.sequence(F.lit(size), F.lit(full - 1))))
            texels = texels.unionByName(edge)
    return texels


def blocks(texels: DataFrame, height: int, width: int, keys: list[str], value: str = "density") -> DataFrame:
    """Texels (keys, vy, vx) as blocks (by, bx) with an array of 16 in row order; sides are padded with their edge."""
    grown = padded(texels, height, width)
    at = F.struct((F.col("vy") % 4).alias("y"), (F.col("vx") % 4).alias("x"), F.col(value).alias("v"))
    grouped = grown.groupBy(*keys, F.shiftright("vy", 2).alias("by"), F.shiftright("vx", 2).alias("bx")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    return grouped.select(*keys, "by", "bx", F.transform("p", lambda s: s["v"].cast("double")).alias("pixels"))


def encode_volume(texels: DataFrame, height: int, width: int, keys: list[str], value: str = "density") -> DataFrame:
    """Texels as encoded blocks (by, bx, content of eight bytes).

    Sides are padded with their edge. A block that lacks texels, has one twice, or holds null or NaN is
    an error that names the block, as is a volume without height or width.
    """
    if height < 1 or width < 1:
        raise ValueError(f"a volume needs sides of at least 1, not {height} x {width}")
    cut = blocks(texels, height, width, keys, value)
    odd = F.exists("pixels", lambda v: v.isNull() | F.isnan(v))
    fault = F.when((F.size("pixels") != 16) | odd, F.raise_error(F.format_string("block %d, %d has %d texels or values that are no numbers", "by", "bx", F.size("pixels"))))
    checked = cut.withColumn("pixels", F.coalesce(fault.cast("array<double>"), "pixels"))
    normal = checked.withColumn("pixels", F.transform("pixels", lambda v: normalised(v)))
    ship(texels.sparkSession)

    @F.pandas_udf("binary")
    def content(pixels: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in encode_blocks(np.stack(pixels.to_list()))] if len(pixels) else [], dtype=object)

    return normal.select(*keys, "by", "bx", content("pixels").alias("content"))


def decode_volume(encoded: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """Encoded blocks as texels (vy, vx, value) between 0 and 1. Only whole blocks within the sides are read, so a side below 4 gives none."""
    ship(encoded.sparkSession)
    inside = encoded.filter((F.col("by") < height // 4) & (F.col("bx") < width // 4))
    each = inside.select(*keys, "by", "bx", F.posexplode(texels_of("content")).alias("_i", "value"))
    return each.select(*keys, (F.col("by") * 4 + F.floor(F.col("_i") / 4)).cast("int").alias("vy"), (F.col("bx") * 4 + F.col("_i") % 4).cast("int").alias("vx"), "value")


def texels_of(content) -> Column:
    """The 16 values of eight bytes, by batches; `decode` does the same on columns."""

    @F.pandas_udf("array<double>")
    def values(content: pd.Series) -> pd.Series:
        return pd.Series(list(decode_blocks(np.frombuffer(b"".join(content), np.uint8).reshape(-1, 8))), dtype=object)

    return values(col(content))
