"""Web-Mercator and grid arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of Web Mercator, and half its circumference.
EARTH_RADIUS = 6378137.0
HALF_CIRCUMFERENCE = math.pi * EARTH_RADIUS
#: Corners that lie on a tile's edge belong to the tile before; the shift is far below a millimetre.
EDGE = 1e-11


def col(x) -> Column:
    """A column from a column, a name or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def side(zoom) -> Column:
    """Tiles along one side at a zoom."""
    return F.shiftleft(F.lit(1), zoom).cast("double") if isinstance(zoom, int) else F.pow(F.lit(2.0), col(zoom))


def tile_x(lon, zoom) -> Column:
    """Longitude in degrees to fractional tile column."""
    return (col(lon) + 180.0) / 360.0 * side(zoom)


def tile_y(lat, zoom) -> Column:
    """Latitude in degrees to fractional tile row, counted from the north."""
    return (1.0 - F.asinh(F.tan(F.radians(col(lat)))) / math.pi) / 2.0 * side(zoom)


def tile_lon(x, zoom) -> Column:
    return col(x) / side(zoom) * 360.0 - 180.0


def tile_lat(y, zoom) -> Column:
    return F.degrees(F.atan(F.sinh((1.0 - 2.0 * col(y) / side(zoom)) * math.pi)))


def merc_x(lon) -> Column:
    """Longitude to metres east."""
    return F.radians(col(lon)) * EARTH_RADIUS


def merc_y(lat) -> Column:
    """Latitude to metres north."""
    return F.log(F.tan(math.pi / 4 + F.radians(col(lat)) / 2.0)) * EARTH_RADIUS


def merc_lon(x) -> Column:
    return F.degrees(col(x) / EARTH_RADIUS)


def merc_lat(y) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(col(y) / EARTH_RADIUS)) - math.pi / 2)


def flip_row(y, zoom) -> Column:
    """Rows counted from the north to rows counted from the south, and back."""
    n = F.shiftleft(F.lit(1), zoom) if isinstance(zoom, int) else F.pow(F.lit(2.0), col(zoom)).cast("int")
    return n - 1 - col(y)


def tile_width(zoom) -> Column:
    """Width of a tile in metres."""
    return 2.0 * HALF_CIRCUMFERENCE / side(zoom)


def tile_bounds(x, y, zoom) -> Column:
    """Struct of left, bottom, right, top in Mercator metres."""
    w = tile_width(zoom)
    left, top = col(x) * w - HALF_CIRCUMFERENCE, HALF_CIRCUMFERENCE - col(y) * w
    return F.struct(left.alias("left"), (top - w).alias("bottom"), (left + w).alias("right"), top.alias("top"))


def tile_range(west, south, east, north, zoom) -> Column:
    """Struct of x0, x1, y0, y1: the tiles that cover a box."""
    return F.struct(
        F.floor(tile_x(west, zoom)).cast("int").alias("x0"),
        F.floor(tile_x(col(east) - EDGE, zoom)).cast("int").alias("x1"),
        F.floor(tile_y(north, zoom)).cast("int").alias("y0"),
        F.floor(tile_y(col(south) + EDGE, zoom)).cast("int").alias("y1"),
    )


def resolution(zoom, pixels: int = 256) -> Column:
    """Metres of a tile's pixel; one zoom less doubles it."""
    return tile_width(zoom) / pixels


def batch_parameters(batch_x, batch_y, zoom, lat0: float, lon0: float, lat_step: float, lon_step: float, batch_tiles: int = 4, pixels: int = 256, halo: int = 32, max_altitude: float = 14000.0, layers: int = 64) -> Column:
    """Where a batch of tiles with its halo lies on the source grid: rows are linear between its two corners."""
    res, size = resolution(zoom, pixels), batch_tiles * pixels + 2 * halo
    box = tile_bounds(batch_x, batch_y, zoom)
    left, top = box["left"] - halo * res, box["top"] + halo * res
    west, north = merc_lon(left), merc_lat(top)
    east, south = merc_lon(left + size * res), merc_lat(top - size * res)
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        res.alias("res_h"),
        F.lit(max_altitude / layers).alias("res_v"),
        ((west - lon0) / lon_step).alias("offset_x"),
        ((north - lat0) / lat_step).alias("offset_y"),
        ((east - west) / lon_step / size).alias("scale_x"),
        ((south - north) / lat_step / size).alias("scale_y"),
    )


def world(mx, my) -> Column:
    """Struct of cos_lat, x, y: Mercator metres to metres on the ground."""
    lat = F.radians(merc_lat(my))
    return F.struct(F.cos(lat).alias("cos_lat"), (col(mx) * F.cos(lat)).alias("x"), (lat * EARTH_RADIUS).alias("y"))


def crop_pixels(left, bottom, right, top, origin_x, origin_y, res, width: int, height: int) -> Column:
    """Struct of px0, px1, py0, py1: a box in metres on a canvas whose top left corner is the origin."""

    def clip(v, most):
        return F.least(F.greatest(v, F.lit(0)), F.lit(most)).cast("int")

    x, y = (lambda m: (col(m) - col(origin_x)) / col(res)), (lambda m: (col(origin_y) - col(m)) / col(res))
    return F.struct(clip(F.floor(x(left)), width).alias("px0"), clip(F.ceil(x(right)), width).alias("px1"), clip(F.floor(y(top)), height).alias("py0"), clip(F.ceil(y(bottom)), height).alias("py1"))


def pixel_metres(px, py, origin_x, origin_y, res) -> Column:
    return F.struct((col(origin_x) + col(px) * col(res)).alias("x"), (col(origin_y) - col(py) * col(res)).alias("y"))


def equirect_row(row, rows: int, north: float, south: float) -> Column:
    """Row of a Mercator image that a row of an equirectangular image of the same box takes."""
    lat = north - (north - south) * (col(row) + 0.5) / rows
    top, bottom = merc_y(F.lit(north)), merc_y(F.lit(south))
    at = (top - merc_y(lat)) / (top - bottom) * rows
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(rows - 1)).cast("int")


def day_offset(target, today) -> Column:
    """Days from a date to a target time."""
    return F.date_diff(col(target).cast("date"), col(today).cast("date"))
