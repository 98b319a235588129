"""Connected components by alternating large and small stars, and clouds as components of a grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..session import ship
from ..storage import dropped, written


#: Parts that the edges of one node are dealt into where its least neighbour is joined to them.
SALTS = 16


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node with the least neighbour of it; edges have u > v.

    Minima combine before the shuffle, and a hub's edges meet its minimum in SALTS parts.
    """
    least = edges.groupBy(F.col("v").alias("c")).agg(F.min("v").alias("m")).union(edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))).groupBy("c").agg(F.min("m").alias("m"))
    salted = edges.select(F.col("v").alias("c"), "u", F.pmod(F.hash("u"), F.lit(SALTS)).alias("salt"))
    parts = salted.select("c", "salt").distinct().join(least, "c")
    return salted.join(parts, ["c", "salt"]).select("u", F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _forest(batches):
    """Edges of one partition as stars: every node with the least node it reaches there, by union-find."""
    parent: dict = {}

    def find(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(1).type)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) that isn't the least of its component; root is that least node.

    Each round first contracts what lies in one partition, then points nodes at their least
    neighbour across partitions; rounds grow with the logarithm of a component's size at most.
    A hub's edges don't gather in one task. It ends when all edges point from a node to a root; nodes
    may be of any ordered type.
    """
    ship(edges.sparkSession)
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    kind = now.schema
    while True:
        last, now = now, written(_small(_large(now.mapInArrow(_forest, kind))), "edges")
        dropped(last)
        more = now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").union(now.groupBy("u").count().filter("count > 1").select("u"))
        if more.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Cells that are labelled together, and at least one level of them.
SLAB = 1 << 18


def labels(index: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Least index of the 6-neighbour component of each cell; cells are sorted indices.

    Neighbours are found by binary search; roots point at their least neighbour, then all cells at the
    root of their root, until nothing changes: a few passes over arrays.
    """
    n = len(index)
    x, y = index % nx, index // nx % ny
    pairs = []
    for step, inside in ((1, x < nx - 1), (nx, y < ny - 1), (nx * ny, None)):
        from_ = np.arange(n) if inside is None else np.flatnonzero(inside)
        at = np.searchsorted(index, index[from_] + step)
        hit = at < n
        hit[hit] = index[at[hit]] == index[from_[hit]] + step
        pairs.append((from_[hit], at[hit]))
    u, v = (np.concatenate(p) for p in zip(*pairs, strict=True))
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return index[root]


def _slabs(nx: int, ny: int, slab: int):
    """Cells in order of their index to cells with the label of their slab, its number, and whether they lie at a face of it."""
    plane = nx * ny

    def done(index: np.ndarray) -> pa.RecordBatch:
        index = index[np.diff(index, prepend=index[0] - 1) > 0]
        z = index // plane
        return pa.RecordBatch.from_arrays([pa.array(index), pa.array(labels(index, nx, ny)), pa.array(np.full(len(index), z[0])), pa.array((z == z[0]) | (z == z[-1]))], ["index", "label", "slab", "face"])

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size < 2 * slab:
                continue
            whole = np.concatenate(held)
            # Cut between levels, the last of which may go on in the next batch.
            ends = np.flatnonzero(np.diff(whole // plane)) + 1
            at = 0
            while (far := ends[ends >= at + slab]).size:
                yield done(whole[at : far[0]])
                at = int(far[0])
            held, size = [whole[at:]], len(whole) - at
        if size:
            yield done(np.concatenate(held))

    return run


def grid_components(cells: DataFrame, nx: int, ny: int, slab: int = SLAB) -> DataFrame:
    """Cells (z, y, x) with the least index of their 6-neighbour component as `root`; index counts x, then y, then z.

    Cells are dealt by ranges of z and labelled slab by slab, with no shuffle of edges. Only faces of
    slabs meet, as pairs of labels, and only those are components of a graph; the roots come back to
    the labels. Repeated cells are one.
    """
    ship(cells.sparkSession)
    index = ((F.col("z") * ny + F.col("y")) * nx + F.col("x")).cast("long")
    dealt = cells.select(index.alias("index")).withColumn("_z", F.floor(F.col("index") / (nx * ny)))
    ordered = dealt.repartitionByRange("_z").sortWithinPartitions("index").select("index")
    labelled = written(ordered.mapInArrow(_slabs(nx, ny, slab), "index long, label long, slab long, face boolean"), "slabs")
    face = labelled.filter("face")
    above = face.select((F.col("index") - nx * ny).alias("index"), F.col("label").alias("v"), F.col("slab").alias("other"))
    edges = face.join(above, "index").filter("slab <> other").select(F.col("label").alias("u"), "v").distinct()
    roots = components(edges).withColumnRenamed("node", "label")
    i = F.col("index")
    placed = labelled.join(roots, "label", "left").select("index", F.coalesce("root", "label").alias("root"))
    return placed.select(F.floor(i / (nx * ny)).alias("z"), (F.floor(i / nx) % ny).alias("y"), (i % nx).alias("x"), "index", "root")


def cloud_figures(cells: DataFrame, split: float = 7000.0) -> DataFrame:
    """Per component: mass, mass above the split, mean height, count and deepest level. Cells have root, z, clc, h_mid."""
    return cells.groupBy("root").agg(
        F.sum("clc").alias("mass_total"),
        F.sum(F.when(F.col("h_mid") > split, F.col("clc")).otherwise(0.0)).alias("mass_high"),
        F.avg("h_mid").alias("mean_height"),
        F.count("*").alias("n_cells"),
        F.max("z").alias("deepest"),
    )


def flatten_cirrus(cells: DataFrame, bases: DataFrame) -> DataFrame:
    """Extinction times thickness of cirrus by layer, y, x.

    Cells have root, z, y, x, clc, qc, qi, h_upper, h_lower; `bases` has (z, y, x, h_lower) of every
    cell of the grid, for the height of a component's deepest level at each column.
    """
    named = cells.withColumn("h_mid", (F.col("h_upper") + F.col("h_lower")) / 2)
    joined = named.join(cloud_figures(named), "root")
    deepest = bases.select(F.col("z").alias("deepest"), "y", "x", F.col("h_lower").alias("deepest_base"))
    joined = joined.join(deepest, ["deepest", "y", "x"], "left")
    high = joined.filter(physics.is_cirrus("deepest_base", "mass_high", "mass_total"))
    beta = physics.extinction_legacy("qc", "qi", physics.barometric_density("h_mid"))
    return high.groupBy(physics.cirrus_layer("mean_height").alias("layer"), "y", "x").agg(F.sum(beta * (F.col("h_upper") - F.col("h_lower"))).alias("optical_depth"))
