"""Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

Rows of the matrix are distinct shingle sets, columns are shingles. Blocks of rows learn the weight
of their columns (in how many sets a shingle occurs) and order each row from rare to frequent. Two
rows that are similar enough must meet in the first columns of both, as many as the size of the row
allows; columns with a single row can't meet anything and are left out. These columns are the mask of
the product: its entries are computed where two rows meet and sizes and positions allow the
similarity. Entries are computed by blocks of rows; their overlaps are accumulated over blocks of
columns, and an entry is discarded as soon as it can't reach the bound that both sizes set.

Within a column, rows are measured against one leader. Rows near it are known by the few shingles
that set them apart from it; two of them can only link, beyond what the leader joins, if they share
some of these, and meet in the rarest, so near copies are never expanded into all pairs. Rows far from it are compared with
those that the triangle inequality allows where they are few. Where they are many, a second leader
is chosen, and then the column is split by a further column: rows that link and share a first column
share a second one among one column more, and so on; only rows that share all of these columns are
compared however many they are.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import blocks as B
from .common import dropped, lean, lean_cogroup, written

#: Bits of a shingle's hash that are dropped where columns are counted; a clash only alters the order.
_DROP = 20


class _Sets:
    """Distinct shingle sets of one block."""

    def __init__(self, names: list, texts: list[bytes], k: int):
        lowered = [t.lower() for t in texts]
        words, hashes, counts = B.hashed_words(lowered)
        ends = np.cumsum(counts)
        starts = np.flatnonzero(B.starts_in(counts, k))
        doc = np.repeat(np.arange(len(names)), counts)[starts]
        key = B.grams(hashes, k)[starts] if len(starts) else np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[e - c : e]), seed=1) for e, c in zip(ends[short].tolist(), counts[short].tolist(), strict=True)], np.uint64)
            doc, key = np.concatenate([doc, short]), np.concatenate([key, whole])
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        doc, key = doc[new], key[new]
        sizes = np.bincount(doc, minlength=len(names))
        ends = np.cumsum(sizes)
        self.members: dict[bytes, list] = {}
        self.empty: list = []
        kept = []
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            if a == b:
                self.empty.append(names[i])
                continue
            digest = xxhash.xxh3_128_digest(key[a:b].tobytes())
            if digest not in self.members:
                self.members[digest] = []
                kept.append(i)
            self.members[digest].append(names[i])
        self.texts = [lowered[i] for i in kept]
        self.digests = list(self.members)
        self.sizes = sizes[kept]
        first = np.zeros(len(names), bool)
        first[kept] = True
        mine = first[doc]
        self.key = key[mine]
        self.row = np.repeat(np.arange(len(kept)), self.sizes)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns by which shingles are counted, the column of each, and how many rows have it."""
        return np.unique(self.key >> np.uint64(_DROP), return_inverse=True, return_counts=True)


def _ask_weights(k: int, digit: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for block, names, texts in B.opened(batch.slice(i, 1)):
                    column, _, times = _Sets(names, texts, k).columns()
                    yield B.batch_of([(0, block, q, body) for q, body in B.keyed_messages(column << np.uint64(_DROP), times, digit=digit)], B.MESSAGES)

    return lean(run)


def _bit_length(total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """0 for a column that has one row in all, else the bit length of its number of rows."""
    return np.where(total < 2, 0, np.floor(np.log2(np.maximum(total, 1))) + 1)


#: Columns that a row lists beyond its first ones, by which full columns are split.
MORE = 3
#: Up to so many rows far from a column's leader, or near it within reach of them, are compared directly; so often a new leader is chosen before a column is split.
FEW, TURNS = 2048, 2

#: Rows of sets have `n` and `members` (and `body` if they meet anything); rows of the matrix have `column`.
_PARTS = "block long, digest binary, n int, members array<long>, body binary, column long, position int, extra int"
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int32(), pa.int32()]


def _rows(k: int, percent: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        pack, out = zstandard.ZstdCompressor(level=3), []
        weight = B.answers_of(answers)
        for block, names, texts in B.opened(blocks):
            mine = _Sets(names, texts, k)
            weights = weight[mine.columns()[1]] if len(mine.key) else np.zeros(0, np.uint8)
            order = np.lexsort((mine.key, weights, mine.row))
            ends = np.cumsum(mine.sizes)
            position = np.arange(len(order)) - np.repeat(ends - mine.sizes, mine.sizes)
            prefix = mine.sizes - (percent * mine.sizes + 99) // 100 + 1
            row = mine.row[order]
            extra = np.maximum(position - prefix[row] + 1, 0)
            meets = np.flatnonzero((extra <= MORE) & (weights[order] > 0))
            some = np.zeros(len(mine.sizes), bool)
            some[row[meets]] = True
            sizes = mine.sizes.tolist()
            for i, (digest, members) in enumerate(mine.members.items()):
                out.append((block, digest, sizes[i], members, pack.compress(mine.texts[i]) if some[i] else None, None, None, None))
            out += [(block, None, 0, [x], None, None, None, None) for x in mine.empty]
            for r, c, p, e in zip(row[meets].tolist(), mine.key[order][meets].view(np.int64).tolist(), position[meets].tolist(), extra[meets].tolist(), strict=True):
                out.append((block, mine.digests[r], sizes[r], None, None, c, p, e))
        cols = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, _KINDS, strict=True)], names=[x.split()[0] for x in _PARTS.split(", ")])

    return lean_cogroup(run)


_MEASURED = "u binary, v binary, nu int, nv int, dist int, linked boolean, near boolean, apart array<long>"
#: Blocks of columns in which overlaps are accumulated, and about how many compressed bytes of rows make one block of the matrix.
COLUMN_BLOCKS, ROW_BLOCK = 4, 1 << 20


def overlaps(sets: _Sets, u: np.ndarray, v: np.ndarray, need: np.ndarray | None) -> np.ndarray:
    """Entries of the product of the incidence matrix with its transpose, at the rows u and columns v.

    Overlaps are accumulated over blocks of columns; with `need`, an entry is discarded (-1) as soon as
    what both rows have in later blocks can't bring it to that bound.
    """
    columns, rank = np.unique(sets.key, return_inverse=True)
    n, ends = len(columns), np.cumsum(sets.sizes)
    edges = np.linspace(0, n, COLUMN_BLOCKS + 1).astype(np.int64)
    cuts = np.searchsorted(sets.row * n + rank, np.arange(len(ends))[:, None] * n + edges)
    if len(np.unique(u)) < len(np.unique(v)):
        u, v = v, u
    total, flag = np.zeros(len(u), np.int64), np.zeros(n, bool)
    alive = np.argsort(v, kind="stable")
    for block in range(COLUMN_BLOCKS):
        runs = np.flatnonzero(np.diff(v[alive], prepend=-1)).tolist() + [len(alive)]
        for a, b in zip(runs, runs[1:], strict=False):
            mine = alive[a:b]
            lo, hi = cuts[v[mine[0]], block : block + 2]
            flag[rank[lo:hi]] = True
            first = cuts[u[mine], block]
            length = cuts[u[mine], block + 1] - first
            bounds = np.zeros(len(mine) + 1, np.int64)
            np.cumsum(length, out=bounds[1:])
            hits = np.zeros(bounds[-1] + 1, np.int64)
            np.cumsum(flag[rank[np.repeat(first - bounds[:-1], length) + np.arange(bounds[-1])]], out=hits[1:])
            total[mine] += np.diff(hits[bounds])
            flag[rank[lo:hi]] = False
        if need is not None:
            rest = np.minimum(ends[u[alive]] - cuts[u[alive], block + 1], ends[v[alive]] - cuts[v[alive], block + 1])
            reaches = total[alive] + rest >= need[alive]
            total[alive[~reaches]] = -1
            alive = alive[reaches]
    return total


def _measure(k: int, percent: int, distances: bool):
    """Of pairs with both texts: sizes and whether they link; with `distances` also the symmetric difference, and if they are near what sets them apart."""

    def part(u: list, v: list, bodies: list, unpack):
        at = {x: i for i, x in enumerate(dict.fromkeys([*u, *v]))}
        raw = dict(zip([*u, *v], bodies, strict=True))
        sets = _Sets([*range(len(at))], [unpack.decompress(raw[x]) for x in at], k)
        left, right = np.array([at[x] for x in u]), np.array([at[x] for x in v])
        size = sets.sizes
        total = size[left] + size[right]
        common = overlaps(sets, left, right, None if distances else -(-percent * total // (100 + percent)))
        linked = (common >= 0) & (100 * common >= percent * (total - common))
        if not distances:
            return [u, v, size[left], size[right], [None] * len(u), linked, np.zeros(len(u), bool), [None] * len(u)]
        dist = total - 2 * common
        near = dist * (100 + percent) <= 2 * (100 - percent) * total
        ends = np.cumsum(size)
        row = lambda i: sets.key[ends[i] - size[i] : ends[i]]
        apart = [np.setxor1d(row(a), row(b), assume_unique=True).view(np.int64) if x else None for a, b, x in zip(left.tolist(), right.tolist(), near.tolist(), strict=True)]
        return [u, v, size[left], size[right], dist, linked, near, apart]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
        for batch in batches:
            u, v, body_u, body_v = (batch.column(c).to_pylist() for c in ("u", "v", "body_u", "body_v"))
            a = 0
            while a < len(u):
                b, held = a, 0
                while b < len(u) and held < ROW_BLOCK:
                    held += len(body_u[b]) + len(body_v[b])
                    b += 1
                cols = part(u[a:b], v[a:b], [*body_u[a:b], *body_v[a:b]], unpack)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], [x.split()[0] for x in _MEASURED.split(", ")])
                a = b

    return lean(run)


def _measured(pairs: DataFrame, sets: DataFrame, k: int, percent: int, name: str, distances: bool = True) -> DataFrame:
    bodies = sets.filter("body is not null").select("digest", "body")
    both = pairs.join(bodies.select(F.col("digest").alias("u"), F.col("body").alias("body_u")), "u").join(bodies.select(F.col("digest").alias("v"), F.col("body").alias("body_v")), "v")
    return written(both.mapInArrow(_measure(k, percent, distances), _MEASURED), name)


def _bound(a: str, b: str, percent: int):
    """Sizes, and what can still overlap from the last common column on, allow the similarity."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.position"), nb - F.col(f"{b}.position")) + F.col(f"{a}.level")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= percent * (na + nb))


def _rooted(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(key), "root"), key, "left").withColumn("root", F.coalesce("root", key))


def _near_links(measured: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between rows near one leader that no link joins yet, from what sets them apart from the leader.

    Two rows differ by their distances less twice what they share of these parts. Of two rows that no
    link joins, one at least is not linked to the leader, so its distance is above the bound, and the
    other must share half of its own parts with it, give or take the sizes. So it is enough that a row
    meets the rows not linked to the leader in its rarest parts, as many as that leaves; parts that most
    rows have, such as the leader's own edits, are met by few. What two rows share is then counted.
    """
    q = (100 - percent) / (100 + percent)
    near = measured.filter("near").select(F.col("u").alias("lead"), F.col("v").alias("digest"), F.col("nu").alias("n_lead"), F.col("nv").alias("n"), "dist", "linked", "apart")
    parts = near.select("lead", "digest", F.explode("apart").alias("part"))
    common = parts.groupBy("lead", "part").agg(F.count("*").alias("c")).filter("c > 1")
    parts = parts.join(common, ["lead", "part"])
    rarest = Window.partitionBy("lead", "digest").orderBy("c", "part")
    cells = _rooted(parts.withColumn("rank", F.row_number().over(rarest)), roots, "digest").join(near.drop("apart"), ["lead", "digest"])
    size = F.count("*").over(Window.partitionBy("lead", "digest"))
    need = F.greatest(F.ceil((F.col("dist") - q * (F.col("n") - F.col("n_lead"))) / 2 - 1e-6), F.lit(1))
    first = cells.withColumn("s", size).filter(F.col("rank") <= F.col("s") - need + 1)
    a, b = first.alias("a"), cells.filter("not linked").alias("b")
    once = F.col("a.linked") | (F.col("a.digest") > F.col("b.digest"))
    met = a.join(b, (F.col("a.lead") == F.col("b.lead")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") != F.col("b.root")) & once)
    met = met.select(F.col("a.lead").alias("lead"), F.col("a.digest").alias("u"), F.col("b.digest").alias("v")).distinct()
    side = lambda as_name, suffix: near.select("lead", F.col("digest").alias(as_name), *[F.col(c).alias(c + suffix) for c in ("n", "dist", "apart")])
    both = met.join(side("u", "_u"), ["lead", "u"]).join(side("v", "_v"), ["lead", "v"])
    total = F.col("n_u") + F.col("n_v")
    apart = F.col("dist_u") + F.col("dist_v") - 2 * F.size(F.array_intersect("apart_u", "apart_v"))
    return both.filter(100 * (total - apart) >= percent * (total + apart)).select("u", "v")


def _joined_pairs(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one column that no link joins yet, within the bounds and those that distances to the column's leader set."""
    a, b = a.alias("a"), b.alias("b")
    far = (100 + percent) * F.abs(F.col("a.dist") - F.col("b.dist")) > (100 - percent) * (F.col("a.n") + F.col("b.n"))
    on = (F.col("a.column") == F.col("b.column")) & (F.col("a.root") != F.col("b.root")) & _bound("a", "b", percent) & ~F.coalesce(far, F.lit(False))
    return a.join(b, on).select(F.greatest("a.digest", "b.digest").alias("u"), F.least("a.digest", "b.digest").alias("v"))


def _split(full: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of columns that are too full, by each further column behind the last common one that one level more allows."""
    more = cells.select("digest", F.col("column").alias("then"), F.col("position").alias("at"), "extra")
    both = full.join(more, "digest").filter("at > position and extra <= level + 1")
    return both.select(F.xxhash64("column", "then").alias("column"), "digest", "n", F.col("at").alias("position"), (F.col("level") + 1).alias("level"), F.lit(0).alias("turn"))


_LEAST = -(1 << 63)


def _name(least_id, digest):
    """A set's name: its smallest id so that names are in order of ids, null last, then its digest."""
    flipped = F.unhex(F.lpad(F.hex(least_id.bitwiseXOR(F.lit(_LEAST))), 16, "0"))
    return F.concat(F.coalesce(F.concat(F.lit(b"\x00"), flipped), F.lit(b"\x01" + b"\xff" * 8)), digest)


def _id_of(name):
    """The id in a set's name."""
    flipped = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long")
    return F.when(F.substring(name, 1, 1) == F.lit(b"\x00"), flipped.bitwiseXOR(F.lit(_LEAST)))


#: Parts that a set's rows, one per block that has it, are dealt into where they get their component.
_SALTS = 32


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, block_bytes: int = 4 << 20, few: int = FEW, digit: int = B.DIGIT, most: int = B.MOST
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and n_set_links.

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles; A-Z
    count as a-z; a text of fewer words has its whole sequence as its one shingle. component_id is the
    smallest doc_id that links reach. A null or empty text has no shingle and is its own component.
    n_set_links is the number of comparisons with other sets that passed (0 if there were none; a lower
    bound of a set's links). Rows without an id keep a null component unless linked to one; repeated
    rows each count. Other columns are ignored; an empty table gives no rows. `few` only chooses how
    pairs are found; `digit` and `most` are those of the block exchange.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes, "ngrams")
    weights = B.exchanged(table.mapInArrow(_ask_weights(k, digit), B.MESSAGES), B.tally(np.add, _bit_length, digit=digit), table.count(), digit, most)
    parts = written(table.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(_rows(k, percent), _PARTS), "rows")
    local = parts.filter("column is null").select("block", "digest", "n", "members", "body")
    nonempty = local.filter("digest is not null")
    known = nonempty.groupBy("digest").agg(F.min(F.array_min("members")).alias("least_id"), F.first("body", ignorenulls=True).alias("body"), F.min("block").alias("home"), F.count("*").alias("homes"))
    named = written(known.select("digest", _name(F.col("least_id"), F.col("digest")).alias("name"), "body", "home", "homes"), "sets")
    sets = named.select(F.col("name").alias("digest"), "body")
    # from here on sets go by their names; one block speaks for the sets that several have
    cells = parts.filter("column is not null").join(named.select("digest", "name", "home"), "digest").filter("block = home")
    cells = written(cells.select("column", F.col("name").alias("digest"), "n", "position", "extra"), "cells")

    left = cells.filter("extra = 0").select("column", "digest", "n", "position", F.lit(0).alias("level"), F.lit(0).alias("turn"))
    links, direct, used = None, [], None
    share = (100 - percent) / (100 + percent)
    while True:
        # each column's leader is the row with the fewest rarer columns; all rows are measured against it
        lead = left.groupBy("column").agg(F.min(F.struct("position", "digest", "n", "level")).alias("lead"), F.count("*").alias("rows")).filter("rows > 1")
        led = left.join(lead.select("column", "lead"), "column")
        asked = led.select(F.struct("digest", "n", "position", "level").alias("me"), "lead").filter("me.digest != lead.digest").filter(_bound("me", "lead", percent))
        measured = _measured(asked.select(F.col("lead.digest").alias("u"), F.col("me.digest").alias("v")).distinct(), sets, k, percent, "measured")
        new = measured.filter("linked").select("u", "v")
        links = new if links is None else links.union(new)
        roots = components(links)
        links = links.union(written(_near_links(measured, roots, percent), "links"))
        dist = measured.select(F.col("u").alias("lead_digest"), F.col("v").alias("digest"), "dist", "near")
        placed = _rooted(led.withColumn("lead_digest", F.col("lead.digest")).join(dist, ["lead_digest", "digest"], "left"), roots, "digest")
        own = F.col("digest") == F.col("lead_digest")
        placed = placed.select("column", "digest", "n", "position", "level", "turn", "root", F.when(own, 0).otherwise(F.col("dist")).alias("dist"), (own | F.coalesce("near", F.lit(False))).alias("near"))
        placed = written(placed, "placed")
        dropped(used)
        used = None
        far = placed.filter("not near")
        if far.isEmpty():
            break
        # of the rows near the leader, those within reach of a far one; a far one without a distance may reach all
        reach = far.groupBy("column").agg(F.min(F.coalesce(F.col("dist") - share * F.col("n"), F.lit(-1e18))).alias("reach"), F.count("*").alias("n_far"))
        ring = placed.filter("near").join(reach, "column").filter(F.col("dist") + share * F.col("n") >= F.col("reach") - 1e-6)
        counts = ring.groupBy("column").agg(F.count("*").alias("n_ring"))
        fate = reach.select("column", "n_far").join(counts, "column", "left").select("column", "n_far", F.coalesce("n_ring", F.lit(0)).alias("n_ring"))
        fate = written(fate.filter("n_far + n_ring > 1"), "fate")
        far = far.join(fate, "column")
        ring = ring.drop("reach", "n_far").join(fate, "column")
        # rows that share columns up to the last level are compared, however many they are
        last = F.col("level") >= MORE
        many, open_ring = (F.col("n_far") > few) & ~last, F.col("n_ring") > few
        direct.append(_joined_pairs(ring.filter(~(many & open_ring)), far.filter(~(many & open_ring)), percent))
        direct.append(_joined_pairs(*[far.filter(~many)] * 2, percent).filter("u != v"))
        again = far.filter(many & ~open_ring & (F.col("turn") + 1 < TURNS)).select("column", "digest", "n", "position", "level", (F.col("turn") + 1).alias("turn"))
        full = far.filter(many & (open_ring | (F.col("turn") + 1 >= TURNS))).unionByName(ring.filter(many & open_ring))
        left = again.unionByName(_split(full.select("column", "digest", "n", "position", "level"), cells))
        left = used = written(left, "left")
        if left.isEmpty():
            break
    if direct:
        pairs = direct[0]
        for more in direct[1:]:
            pairs = pairs.union(more)
        links = links.union(_measured(pairs.distinct(), sets, k, percent, "measured", distances=False).filter("linked").select("u", "v"))
    every = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    degree = every.select(F.col("u").alias("name")).union(every.select(F.col("v").alias("name"))).groupBy("name").agg(F.count("*").alias("n_set_links"))
    # names are in order of ids, so a component's least name has its least id
    classes = named.select("digest", "name", "home", "homes").join(components(every).withColumnRenamed("node", "name"), "name", "left").join(degree, "name", "left")
    salts = F.when(F.col("homes") == 1, F.array(F.pmod(F.hash("home"), F.lit(_SALTS)))).otherwise(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    classes = classes.select("digest", _id_of(F.coalesce("root", "name")).alias("component_id"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"), F.explode(salts).alias("salt"))
    rows = nonempty.select("digest", "n", "members", F.pmod(F.hash("block"), F.lit(_SALTS)).alias("salt")).join(classes, ["digest", "salt"])
    full = rows.select(F.explode("members").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", "n_set_links")
    none = local.filter("digest is null").select(F.explode("members").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"))
    return full.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_set_links")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their component, and rows without an id; all columns.

    An id that several rows have stays with all of them if any of them stays.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    gone = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select("doc_id")
    plain = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*plain)
    at = plain[docs.columns.index(id_col)]
    return rows.join(gone, rows[at].cast("long") == gone["doc_id"], "left_anti").toDF(*docs.columns)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
