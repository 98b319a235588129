"""GRIB2 messages: an inventory from headers alone, and fields decoded message by message.

`inventory` reads the sections before the data of every message, by ranges; `fields` takes rows of it,
filtered at will, and reads and decodes those messages only, each in whatever task its row is. So a
field of one level is had from a large file without the rest of it. Regular grids of latitude and
longitude with simple packing and bitmaps, several fields in a message too; other templates are
listed, and are an error when decoded. Files are opened by pyarrow, and must not be compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Discipline, category and number of parameters by short name.
PARAMETERS = {
    "t": (0, 0, 0), "qv": (0, 1, 0), "qc": (0, 1, 22), "qi": (0, 1, 82), "u": (0, 2, 2), "v": (0, 2, 3), "w": (0, 2, 9), "p": (0, 3, 0), "hhl": (0, 3, 6), "clc": (0, 6, 22), "clct": (0, 6, 1), "tke": (0, 19, 11),
}
#: Types of level by the code of the first surface.
LEVELS = {1: "surface", 8: "nominalTop", 10: "atmosphere", 100: "isobaricInhPa", 101: "meanSea", 103: "heightAboveGround", 150: "generalVertical"}
#: Minutes of a unit of time.
UNITS = {0: 1, 1: 60, 2: 1440, 10: 180, 11: 360, 12: 720}
_NAMES = {v: k for k, v in PARAMETERS.items()}
_CODES = {v: k for k, v in LEVELS.items()}
_MISSING = 0xFFFFFFFF
#: Product templates that begin with parameter, time and surfaces.
_PRODUCTS = (0, 1, 8, 11)


def _signed(value: int, bits: int) -> int:
    """Sign and magnitude, as all negative numbers of the format are."""
    top = 1 << (bits - 1)
    return -(value - top) if value & top else value


def _magnitude(value: int, bits: int) -> int:
    return abs(value) | ((1 << (bits - 1)) if value < 0 else 0)


@dataclass
class Header:
    """What the sections before the data of one field say."""

    offset: int = 0
    bytes: int = 0
    number: int = 0
    discipline: int = 0
    category: int | None = None
    parameter: int | None = None
    short_name: str | None = None
    type_of_level: str | None = None
    level: float | None = None
    run_ts: datetime | None = None
    step_minutes: int | None = None
    grid: int | None = None
    ni: int | None = None
    nj: int | None = None
    lat1: float | None = None
    lon1: float | None = None
    dlat: float | None = None
    dlon: float | None = None
    scan: int | None = None
    packing: int | None = None
    bits: int | None = None
    points: int | None = None
    sections: dict = field(default_factory=dict, repr=False)


def _section(h: Header, number: int, body: bytes) -> None:
    """Takes what a section (whole, with its 5 first bytes) says into the header."""
    if number == 1:
        year, *rest = struct.unpack_from(">H5B", body, 12)
        h.run_ts = datetime(year, *rest)
    elif number == 3:
        (h.grid,) = struct.unpack_from(">H", body, 12)
        if h.grid == 0:
            h.ni, h.nj = struct.unpack_from(">II", body, 30)
            la1, lo1 = (_signed(x, 32) for x in struct.unpack_from(">II", body, 46))
            la2, lo2, di, dj = (_signed(x, 32) for x in struct.unpack_from(">IIII", body, 55))
            h.scan = body[71]
            # The steps between the ends are finer than the rounded increments; the flags say which way they go.
            width = lo2 - lo1 if h.scan & 0x80 else (lo2 - lo1) % 360_000_000
            h.lat1, h.lon1 = la1 / 1e6, lo1 / 1e6
            h.dlat = (la2 - la1) / 1e6 / (h.nj - 1) if h.nj > 1 else (1 if h.scan & 0x40 else -1) * dj / 1e6
            h.dlon = width / 1e6 / (h.ni - 1) if h.ni > 1 else (-1 if h.scan & 0x80 else 1) * di / 1e6
    elif number == 4:
        (template,) = struct.unpack_from(">H", body, 7)
        h.category, h.parameter = body[9], body[10]
        h.short_name = _NAMES.get((h.discipline, h.category, h.parameter))
        h.type_of_level = h.level = h.step_minutes = None
        if template in _PRODUCTS:
            unit, time = struct.unpack_from(">BI", body, 17)
            h.step_minutes = _signed(time, 32) * UNITS[unit] if unit in UNITS else None
            kind, scale, value, second = struct.unpack_from(">BBIB", body, 22)
            h.type_of_level = LEVELS.get(kind, str(kind)) + ("Layer" if second != 255 and second == kind else "")
            h.level = 0.0 if value == _MISSING else _signed(value, 32) * 10.0 ** -(0 if scale == 255 else _signed(scale, 8)) / (100 if kind == 100 else 1)
    elif number == 5:
        h.points, h.packing = struct.unpack_from(">IH", body, 5)
        h.bits = body[19] if h.packing == 0 else None


def headers(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Header]:
    """Headers of all fields of a file; `read_at` gives bytes at an offset. Data are skipped, and so is what lies between messages."""
    at = 0
    while at + 16 <= size:
        head = read_at(at, 16)
        if head[:4] != b"GRIB":
            ahead = read_at(at, min(1 << 16, size - at))
            found = ahead.find(b"GRIB", 1)
            at += found if found > 0 else max(1, len(ahead) - 3)
            continue
        if head[7] != 2:
            raise ValueError(f"edition {head[7]} at byte {at} is not read")
        (total,) = struct.unpack_from(">Q", head, 8)
        if total < 20 or at + total > size:
            raise ValueError(f"the message at byte {at} is cut off")
        now, inside = Header(at, total, 0, head[6]), 16
        while inside < total - 4:
            length, number = struct.unpack(">IB", read_at(at + inside, 5))
            if length < 5 or inside + length > total - 4:
                raise ValueError(f"a section of {length} bytes at byte {at + inside} doesn't fit its message")
            if number in (1, 3, 4, 5):
                _section(now, number, read_at(at + inside, length))
            now.sections[number] = (inside, length)
            if number == 7:
                now.number += 1
                yield Header(**{k: v for k, v in vars(now).items() if k != "sections"}, sections=dict(now.sections))
            inside += length
        at += total


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """n unsigned numbers of so many bits, side by side."""
    if bits == 0:
        return np.zeros(n, np.uint64)
    at = np.arange(n, dtype=np.int64) * bits
    whole = np.frombuffer(data + b"\0" * 8, np.uint8)
    first = at >> 3
    out = np.zeros(n, np.uint64)
    for k in range(-(-(bits + 7) // 8)):
        out = (out << np.uint64(8)) | whole[first + k]
    kept = -(-(bits + 7) // 8) * 8 - bits
    return (out >> (kept - (at & 7)).astype(np.uint64)) & np.uint64((1 << bits) - 1)


def packed(numbers: np.ndarray, bits: int) -> bytes:
    if bits == 0:
        return b""
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((numbers[:, None].astype(np.uint64) >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def values(message: bytes, h: Header) -> np.ndarray:
    """The field as rows of the grid, in the order of its latitudes and longitudes; NaN where the bitmap has no value."""
    if h.grid != 0 or h.packing != 0:
        raise ValueError(f"grid template {h.grid} with packing {h.packing} is not decoded")
    at5, _ = h.sections[5]
    base, e, d, bits = struct.unpack_from(">fHHB", message, at5 + 11)
    e, d = _signed(e, 16), _signed(d, 16)
    at6, length6 = h.sections[6]
    at7, length7 = h.sections[7]
    n = h.ni * h.nj
    kind = message[at6 + 5]
    if kind == 254:
        at6, length6, kind = *h.sections["bitmap"], 0
    if kind not in (0, 255):
        raise ValueError(f"bitmap {kind} is not in the message")
    here = None if kind == 255 else np.unpackbits(np.frombuffer(message, np.uint8, length6 - 6, at6 + 6))[:n].astype(bool)
    numbers = unpacked(message[at7 + 5 : at7 + length7], bits, h.points)
    found = (float(base) + numbers * 2.0**e) / 10.0**d
    flat = np.full(n, np.nan)
    flat[slice(None) if here is None else here] = found
    rows = flat.reshape(h.ni, h.nj).T if h.scan & 0x20 else flat.reshape(h.nj, h.ni)
    if h.scan & 0x10:
        rows = rows.copy()
        across = rows.T if h.scan & 0x20 else rows
        across[1::2] = across[1::2, ::-1]
    return rows


def encode(rows: np.ndarray, short_name: str, type_of_level: str, level: int, run_ts: datetime, step_minutes: int, corner: tuple[float, float], step: tuple[float, float], bits: int = 16, decimals: int = 0) -> bytes:
    """One message of a regular grid; `corner` and `step` are latitude and longitude of the first point and to the next row and column. NaN has no value.

    Numbers are kept to `decimals` where `bits` suffice for their range, and coarser by powers of two where not.
    """
    discipline, category, parameter = PARAMETERS[short_name]
    nj, ni = rows.shape
    flat = np.asarray(rows, np.float64).ravel()
    here = ~np.isnan(flat)
    scaled = flat[here] * 10.0**decimals
    base = float(np.float32(np.floor(scaled.min()))) if len(scaled) else 0.0
    span = scaled.max() - base if len(scaled) else 0.0
    e = 0
    while span / 2.0**e > (1 << bits) - 1.5:
        e += 1
    if span == 0:
        bits = 0
    numbers = np.rint((scaled - base) / 2.0**e).astype(np.int64)
    (lat, lon), (dlat, dlon) = corner, step
    micro = lambda x: _magnitude(round(x * 1e6), 32)
    scan = (0x40 if dlat > 0 else 0) | (0x80 if dlon < 0 else 0)
    pressure = 100 if type_of_level == "isobaricInhPa" else 1
    parts = [
        (1, struct.pack(">HHBBBH5BBB", 0, 0, 2, 0, 1, run_ts.year, run_ts.month, run_ts.day, run_ts.hour, run_ts.minute, run_ts.second, 0, 1)),
        (3, struct.pack(">BIBBH", 0, ni * nj, 0, 0, 0) + struct.pack(">B" + "BI" * 3, 6, 0, 0, 0, 0, 0, 0) + struct.pack(">IIII", ni, nj, 0, _MISSING)
            + struct.pack(">IIBIIIIB", micro(lat), micro(lon), 48, micro(lat + dlat * (nj - 1)), micro(lon + dlon * (ni - 1)), micro(abs(dlon)), micro(abs(dlat)), scan)),
        (4, struct.pack(">HHBBBBBHBBI", 0, 0, category, parameter, 2, 0, 0, 0, 0, 0, _magnitude(step_minutes, 32)) + struct.pack(">BBIBBI", _CODES[type_of_level], 0, _magnitude(level * pressure, 32), 255, 255, _MISSING)),
        (5, struct.pack(">IHfHHBB", len(numbers), 0, base, _magnitude(e, 16), _magnitude(decimals, 16), bits, 0)),
        (6, b"\xff" if here.all() else b"\0" + np.packbits(here).tobytes()),
        (7, packed(numbers, bits)),
    ]
    body = b"".join(struct.pack(">IB", len(x) + 5, n) + x for n, x in parts) + b"7777"
    return b"GRIB\0\0" + bytes([discipline, 2]) + struct.pack(">Q", len(body) + 16) + body


_COLUMNS = {
    "offset": pa.int64(), "bytes": pa.int64(), "number": pa.int32(), "discipline": pa.int32(), "category": pa.int32(), "parameter": pa.int32(), "short_name": pa.string(), "type_of_level": pa.string(), "level": pa.float64(),
    "run_ts": pa.timestamp("us", "UTC"), "step_minutes": pa.int64(), "grid": pa.int32(), "ni": pa.int32(), "nj": pa.int32(), "lat1": pa.float64(), "lon1": pa.float64(), "dlat": pa.float64(), "dlon": pa.float64(), "scan": pa.int32(), "packing": pa.int32(), "bits": pa.int32(), "points": pa.int64(),
}
_INVENTORY = "path string, offset long, bytes long, number int, discipline int, category int, parameter int, short_name string, type_of_level string, level double, run_ts timestamp, step_minutes long, grid int, ni int, nj int, lat1 double, lon1 double, dlat double, dlon double, scan int, packing int, bits int, points long, error string"


def _opened(uri: str):
    store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return store.open_input_file(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*.grib2") -> DataFrame:
    """One row per field of the files under a path, from their headers; data are not read. A file that can't be read ends with a row that has its error.

    An empty file has no rows. `number` counts the fields of a message from 1, `offset` and `bytes` are the message's.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, error = [], None
                try:
                    with _opened(name) as f:
                        for h in headers(lambda at, n, f=f: f.read_at(n, at), size):
                            found.append(h)
                            if len(found) == 10_000:
                                yield rows(name, found, None)
                                found = []
                except Exception as e:  # what could be read of the file stays
                    error = f"{type(e).__name__}: {e}"[:200]
                yield rows(name, found, error)

    def rows(name, found, error):
        n = len(found) + (error is not None)
        cols = [pa.array([getattr(h, c) for h in found] + [None] * (n - len(found)), kind) for c, kind in _COLUMNS.items()]
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *cols, pa.array([None] * len(found) + [error] * (n - len(found)), pa.string())], ["path", *_COLUMNS, "error"])

    return files.mapInArrow(run, _INVENTORY)


def _within(first: float, step: float, n: int, low: float, high: float) -> tuple[int, int]:
    """First and one past the last of n coordinates between two ends, both included."""
    at = first + step * np.arange(n)
    hit = np.flatnonzero((at >= low - 1e-9) & (at <= high + 1e-9))
    return (int(hit[0]), int(hit[-1]) + 1) if len(hit) else (0, 0)


_FIELDS = "path string, offset long, number int, short_name string, type_of_level string, level double, run_ts timestamp, step_minutes long, iy0 int, ix0 int, ny int, nx int, values array<float>"


def fields(found: DataFrame, box: tuple[float, float, float, float] | None = None, parallel: int | None = None) -> DataFrame:
    """Fields of inventory rows, a row each with its values by rows; null where there is none. `box` (south, west, north, east) cuts before the values leave the task.

    Rows with an error are left out. A box outside a field's grid is an error, as is a template that isn't decoded.
    """
    spark = found.sparkSession
    ship(spark)
    plain = found.filter("error IS NULL").select("path", "offset", "bytes", "number")
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.timestamp("us", "UTC"), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.float32())]

    def run(batches):
        for batch in batches:
            for path, offset, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as f:
                    message = f.read_at(size, offset)
                bitmap = None
                for h in headers(lambda at, n, m=message: m[at : at + n], size):
                    at6, length6 = h.sections[6]
                    if message[at6 + 5] == 0:
                        bitmap = (at6, length6)
                    if h.number == number:
                        break
                h.sections["bitmap"] = bitmap or (0, 0)
                if message[h.sections[6][0] + 5] == 254 and bitmap is None:
                    raise ValueError(f"{path}, byte {offset}: no bitmap before the one that refers to it")
                rows = values(message, h)
                y0, y1, x0, x1 = 0, h.nj, 0, h.ni
                if box:
                    y0, y1 = _within(h.lat1, h.dlat, h.nj, box[0], box[2])
                    x0, x1 = _within(h.lon1, h.dlon, h.ni, box[1], box[3])
                    if y0 == y1 or x0 == x1:
                        raise ValueError(f"{box} is outside the grid of {path}, byte {offset}")
                flat = rows[y0:y1, x0:x1].astype(np.float32).ravel()
                listed = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, from_pandas=True))
                one = [path, offset, number, h.short_name, h.type_of_level, h.level, h.run_ts, h.step_minutes, y0, x0, y1 - y0, x1 - x0]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(one, kinds, strict=False)), listed], names)

    return plain.repartition(parallel or int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, _FIELDS)


def cube(decoded: DataFrame) -> DataFrame:
    """Fields as the long cube (var, level, iy, ix, value), counted from the cut; cells without a value are left out."""
    each = decoded.select(F.col("short_name").alias("var"), F.col("level").cast("int").alias("level"), "nx", F.posexplode("values").alias("i", "value"))
    return each.filter("value IS NOT NULL").select("var", "level", F.floor(F.col("i") / F.col("nx")).cast("int").alias("iy"), (F.col("i") % F.col("nx")).cast("int").alias("ix"), "value")
