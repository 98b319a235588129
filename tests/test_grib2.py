"""GRIB2 messages: bit packing, headers by ranges, scanning orders, several fields in a message, broken files."""

import struct
from datetime import datetime

import numpy as np
import pytest

from stratavox.sources import grib2

RUN = datetime(2024, 2, 29, 18)


def made(rows, **k):
    return grib2.encode(np.asarray(rows, float), **({"short_name": "t", "type_of_level": "generalVertical", "level": 7, "run_ts": RUN, "step_minutes": 120, "corner": (47.0, 9.0), "step": (0.5, 0.25)} | k))


def reader(data):
    read = []

    def read_at(at, n):
        read.append(n)
        return data[at : at + n]

    return read_at, read


def all_of(data):
    return list(grib2.headers(reader(data)[0], len(data)))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 12, 16, 17, 24, 25, 31, 32])
def test_numbers_of_any_width(bits):
    r = np.random.default_rng(bits)
    n = r.integers(0, 1 << bits, 101).astype(np.uint64)
    data = grib2.packed(n, bits)
    text = "".join(f"{x:0{bits}b}" for x in n.tolist())
    assert data == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert (grib2.unpacked(data, bits, 101) == n).all()


def test_round_trip_with_missing_negative_and_constant_values():
    r = np.random.default_rng(1)
    rows = np.round(r.normal(-5, 40, (5, 9)), 1)
    rows[1, 2] = rows[4, 8] = np.nan
    for data, want, tolerance in ((made(rows, bits=16, decimals=1), rows, 1e-6), (made(rows, bits=6), rows, 4), (made(np.full((2, 3), -7.0)), np.full((2, 3), -7.0), 0), (made(np.full((2, 2), np.nan)), np.full((2, 2), np.nan), 0)):
        (h,) = all_of(data)
        assert np.allclose(grib2.values(data, h), want, atol=tolerance, equal_nan=True)
        assert (h.short_name, h.type_of_level, h.level, h.run_ts, h.step_minutes, h.ni, h.nj, h.bytes) == ("t", "generalVertical", 7, RUN, 120, want.shape[1], want.shape[0], len(data))
    (h,) = all_of(made(rows, short_name="u", type_of_level="isobaricInhPa", level=850, corner=(-10.0, 359.0), step=(-0.5, 0.5), step_minutes=-60))
    assert (h.short_name, h.type_of_level, h.level, h.lat1, h.lon1, h.dlat, h.dlon, h.step_minutes) == ("u", "isobaricInhPa", 850, -10.0, 359.0, -0.5, 0.5, -60)


def sections(data):
    out, at = [], 16
    while data[at : at + 4] != b"7777":
        (n,) = struct.unpack_from(">I", data, at)
        out.append(bytearray(data[at : at + n]))
        at += n
    return out


def whole(parts):
    body = b"".join(parts) + b"7777"
    return b"GRIB\0\0\0\2" + struct.pack(">Q", len(body) + 16) + body


def test_scanning_orders():
    rows = np.arange(12.0).reshape(3, 4)
    for scan in (0x40, 0x50, 0x60, 0x70, 0x00, 0xC0):
        stored = rows.T.copy() if scan & 0x20 else rows.copy()
        if scan & 0x10:
            stored[1::2] = stored[1::2, ::-1].copy()
        parts = sections(made(stored.reshape(3, 4)))
        parts[1][71] = scan
        data = whole(parts)
        (h,) = all_of(data)
        assert (grib2.values(data, h) == rows).all(), hex(scan)


def test_several_fields_share_sections_and_bitmaps():
    a = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]])
    first, second, third = sections(made(a)), sections(made(a * 10, level=8)), sections(made(np.ones((2, 3)) * 2, short_name="qc", level=9))
    second[4] = bytearray(struct.pack(">IBB", 6, 6, 254))
    data = whole([*first, *second[2:], *third[2:]])
    assert [(h.number, h.short_name, h.level, h.offset) for h in all_of(data)] == [(1, "t", 7, 0), (2, "t", 8, 0), (3, "qc", 9, 0)]
    hs = all_of(data)
    hs[1].sections["bitmap"] = hs[0].sections[6]
    assert np.allclose(grib2.values(data, hs[1]), a * 10, equal_nan=True) and (grib2.values(data, hs[2]) == 2).all()


def test_headers_skip_data_and_what_lies_between():
    big = made(np.random.default_rng(2).uniform(0, 1e4, (300, 400)), bits=24)
    data = b"WMO header\r\n" + big + b"\0" * 100 + made(np.ones((2, 2)), short_name="qv")
    read_at, read = reader(data)
    found = list(grib2.headers(read_at, len(data)))
    assert [h.short_name for h in found] == ["t", "qv"] and found[1].offset == len(data) - found[1].bytes
    assert sum(n for n in read if n < 1000) < 1500 and max(read) <= 1 << 16


def test_broken_files(spark, tmp_path):
    good = made(np.ones((2, 2)))
    (tmp_path / "a.grib2").write_bytes(good + good[:-30])
    (tmp_path / "b.grib2").write_bytes(b"GRIB\0\0\0\1" + b"\0" * 40)
    (tmp_path / "c.grib2").write_bytes(b"")
    (tmp_path / "d.grib2").write_bytes(b"no message in here")
    parts = sections(good)
    parts[3][9:11] = struct.pack(">H", 40)
    (tmp_path / "e.grib2").write_bytes(whole(parts))
    rows = {(r.path[-7], r.offset): r for r in grib2.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", 0), ("a", None), ("b", None), ("e", 0)}
    assert "cut off" in rows["a", None].error and "edition 1" in rows["b", None].error and rows["e", 0].packing == 40 and rows["e", 0].error is None
    found = grib2.inventory(spark, str(tmp_path))
    ok = grib2.fields(found.filter("packing = 0")).collect()
    assert [(r.ny, r.nx, r["values"]) for r in ok] == [(2, 2, [1.0] * 4)]
    with pytest.raises(Exception, match="packing 40"):
        grib2.fields(found).collect()
    with pytest.raises(Exception, match="outside the grid"):
        grib2.fields(found.filter("packing = 0"), (0.0, 0.0, 1.0, 1.0)).collect()


def test_box_includes_both_ends(spark, tmp_path):
    rows = np.arange(30.0).reshape(5, 6)
    rows[2, 3] = np.nan
    (tmp_path / "a.grib2").write_bytes(made(rows, bits=12))
    got = grib2.cube(grib2.fields(grib2.inventory(spark, str(tmp_path)), (47.5, 9.25, 48.5, 10.0))).collect()
    want = {(i, j): rows[i + 1, j + 1] for i in range(3) for j in range(4) if not np.isnan(rows[i + 1, j + 1])}
    assert {(r.iy, r.ix): r.value for r in got} == want and len(want) == 11
