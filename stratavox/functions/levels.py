"""Model columns as arrays over levels, sampled at many points at once.

Each point has 16 neighbours: rows of `Columns`, or none (-1) where a column is missing. Works on
batches of points; what they ask for lies in one tile of columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shear import CELLS, pchip


class Columns:
    """Model columns of a tile by their place; arrays over levels, filled up to equal lengths, with their own lengths."""

    def __init__(self, rows: pa.StructArray, fields: list[str], y0: int, x0: int, side: int):
        self.values, self.sizes = {}, {}
        for name in fields:
            lists = pc.struct_field(rows, name)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.full((len(rows), max(1, n.max(initial=0))), np.nan)
            whole[np.arange(whole.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            self.values[name], self.sizes[name] = whole, n
        self.y0, self.x0, self.at = y0, x0, np.full((side, side), -1)
        y, x = (pc.struct_field(rows, c).to_numpy(zero_copy_only=False) for c in ("iy", "ix"))
        self.at[y - y0, x - x0] = np.arange(len(rows))
        hhl = self.values["hhl"]
        inside = np.arange(hhl.shape[1] - 1) < self.sizes["hhl"][:, None] - 1
        self.centres = np.where(inside, (hhl[:, :-1] + hhl[:, 1:]) / 2, -np.inf)
        self.top, self.low = hhl[:, 0], hhl[np.arange(len(hhl)), np.maximum(self.sizes["hhl"] - 1, 0)]

    def read(self, name: str, row: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Values at level i of columns, the index held inside."""
        return self.values[name][row[..., None], np.maximum(np.minimum(i, self.sizes[name][row][..., None] - 1), 0)]

    def near(self, x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the 16 B-spline neighbours of points, held at the edges of the grid, and their weights."""
        rows, weights = [], []
        for v, n, start in ((y, ny, self.y0), (x, nx, self.x0)):
            cell = np.floor(v)
            t = v - cell
            u = 1.0 - t
            weights.append(np.stack([u**3 / 6.0, (4.0 - 6.0 * t**2 + 3.0 * t**3) / 6.0, (4.0 - 6.0 * u**2 + 3.0 * u**3) / 6.0, t**3 / 6.0], -1))
            whole = np.clip(np.nan_to_num(cell, nan=0.0), -4, n + 4).astype(np.int64)
            rows.append(np.clip(whole[:, None] + np.arange(-1, 3), 0, n - 1) - start)
        at = self.at[rows[0][:, :, None], rows[1][:, None, :]]
        return at.reshape(len(x), 16), (weights[0][:, :, None] * weights[1][:, None, :]).reshape(len(x), 16)


def _full_level(c: Columns, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes k-1..k+2 around the cell that holds each height, and the heights of their centres; centres beyond either end come from half levels that repeat."""
    k = np.maximum((c.centres[row] >= h[:, None, None]).sum(-1) - 1, 0)
    node = k[..., None] + np.arange(-1, 3)
    return node, (c.read("hhl", row, node) + c.read("hhl", row, node + 1)) / 2


def _total(valid: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(valid, value * weight, 0.0).sum(1)


def material(c: Columns, row: np.ndarray, weight: np.ndarray, h: np.ndarray, fields) -> dict[str, np.ndarray]:
    """Weighted sums of fields over neighbours that span the height, and `w`, the sum of their weights."""
    node, z = _full_level(c, row, h)
    at = h[:, None]
    valid = (row >= 0) & (at < c.top[row]) & (at >= c.low[row])
    sums = {f: _total(valid & (c.sizes[f] > 0)[row], pchip(z, c.read(f, row, node), at, True), weight) for f in fields}
    return sums | {"w": np.where(valid, weight, 0.0).sum(1)}


def turbulence(c: Columns, row: np.ndarray, weight: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted sum of tke on half levels, the height held above the ground, over columns whose top is above, and `w`."""
    at = h[:, None]
    k = np.maximum(np.minimum((c.values["hhl"][row] >= at[..., None]).sum(-1) - 1, c.sizes["hhl"][row] - 2), 0)
    node = k[..., None] + np.arange(-1, 3)
    valid = (row >= 0) & (at < c.top[row])
    value = pchip(c.read("hhl", row, node), c.read("tke", row, node), np.fmax(at, c.low[row]), True)
    return {"tke": _total(valid & (c.sizes["tke"] > 0)[row], value, weight), "w": np.where(valid, weight, 0.0).sum(1)}


def ground(c: Columns, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted height of the lowest half level."""
    return _total(row >= 0, c.low[row], weight)


def older(c: Columns, row: np.ndarray, weight: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fields of the older kernel, `shear.FIELDS` in order.

    Neighbours whose column doesn't span a height, both ends excluded, add nothing, and the other
    weights aren't made up to 1. w lies on half levels and takes the interval of these that holds the height.
    """
    node, z = _full_level(c, row, h)
    at = h[:, None]
    valid = (row >= 0) & (at < c.top[row]) & (at > c.low[row])
    cell = np.minimum(node, c.sizes["hhl"][row][..., None] - 2)
    out = [_total(valid, pchip(z, c.read(f, row, cell), at), weight) for f in CELLS]
    lower = at < c.read("hhl", row, node[..., 1:2] + 1)[..., 0]
    beside = node + lower[..., None]
    return np.stack([*out, _total(valid, pchip(c.read("hhl", row, beside), c.read("w", row, beside), at), weight)])
