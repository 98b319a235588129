"""Periodic runs of words, by tandem repeats in linear time after Gusfield and Stoye.

A run of 12 words or more is covered by 6-word grams that occur again within it, so only stretches
of a text that such grams cover are looked into; this loses nothing. In a stretch, Lempel-Ziv blocks
come from its suffix array. The leftmost occurrence of every square crosses the border of a block,
where extensions both ways (Z functions) find a set of squares that covers all leftmost ones. Walks
along suffix links rotate each of them, first word to the end, through the suffix tree (intervals of
the suffix array) until a square that is marked already or absent, which completes the vocabulary.
The leaves below each square of it locate its occurrences; neighbours of one period merge into runs.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, texts

LEAST, GRAM = 12, 6
#: Words whose texts are looked into together; a longer text is looked into alone.
TOGETHER = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _covered(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each word lies in a 6-word gram that occurs twice with one owner; grams don't cross owners. Clashes of hashes only add words."""
    n = len(words) - GRAM + 1
    out = np.zeros(len(words), bool)
    if n <= 0:
        return out
    h = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(GRAM):
        h = (h ^ words[j : n + j].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    h = np.where(owner[:n] == owner[GRAM - 1 :], h, np.arange(n, dtype=np.uint64))
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    at = np.searchsorted(twice, h)
    hit = np.flatnonzero((at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == h) & (owner[:n] == owner[GRAM - 1 :]))
    for j in range(GRAM):
        out[hit + j] = True
    return out


def stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie, as (start, end): covered by grams repeated within, as far as repeating that question shrinks them."""
    at = np.arange(len(words))
    while True:
        keep = _covered(words, owner)
        left, mine, group = at[keep], owner[keep], None
        if not len(left):
            return []
        cut = np.concatenate([[True], (np.diff(left) > 1) | (np.diff(mine) != 0)])
        group = np.cumsum(cut) - 1
        long = (np.bincount(group) >= LEAST)[group]
        done = len(left) == len(words) and bool(long.all()) and len(np.unique(owner)) == group[-1] + 1
        words, at, owner = words[keep][long], left[long], group[long]
        if not len(at):
            return []
        if done:
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(firsts, [*firsts[1:], len(at)], strict=True)]


def suffix_array(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Suffixes in order, owner by owner, each ending with its owner; by doubling, over what is not yet told apart."""
    n = len(words)
    ends = np.searchsorted(owner, owner, "right")
    _, first = np.unique(words, return_inverse=True)
    key = owner.astype(np.int64) * (int(first.max()) + 1) + first
    sa = np.argsort(key, kind="stable")
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    keys, k = key[sa], 1
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = places[np.flatnonzero(new)]
        group = np.cumsum(new) - 1
        rank[sa[places]] = heads[group]
        open_ = (np.bincount(group) > 1)[group]
        places = places[open_]
        if not len(places):
            return sa
        here = sa[places]
        nxt = here + k
        follow = np.where(nxt < ends[here], rank[np.minimum(nxt, n - 1)] + 1, 0)
        keys = rank[here] * (n + 2) + follow
        order = np.argsort(keys, kind="stable")
        sa[places] = here[order]
        keys = keys[order]
        k *= 2


def _z(s: list) -> list:
    """Length of the common beginning of s and each of its ends."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right or k == 0:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            if i + k > right:
                left, right = i, i + k
        z[i] = k
    return z


def common_prefixes(t: list, sa: list, rank: list) -> list:
    """Common prefix of each suffix, in order, with the one before it; one more 0 at the end."""
    n, k = len(t), 0
    lcp = [0] * (n + 1)
    for i in range(n):
        r = rank[i]
        if r == 0:
            k = 0
            continue
        j = sa[r - 1]
        while i + k < n and j + k < n and t[i + k] == t[j + k]:
            k += 1
        lcp[r] = k
        if k:
            k -= 1
    return lcp


def blocks(sa: list, lcp: list) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end: each block is the longest beginning that also starts earlier, or one new word."""
    n = len(sa)
    before, after, low, high, previous = [-1] * n, [-1] * n, [0] * n, [0] * n, [0] * n
    for r, i in enumerate(sa):
        if r:
            before[i] = sa[r - 1]
            low[i] = lcp[r]
        if r + 1 < n:
            after[i] = sa[r + 1]
            high[i] = lcp[r + 1]
    for i in range(n - 1, -1, -1):
        a, b, p, q = low[i], high[i], before[i], after[i]
        previous[i] = a if a > b else b
        m = a if a < b else b
        if p >= 0:
            after[p], high[p] = q, m
        if q >= 0:
            before[q], low[q] = p, m
    out, i = [], 0
    while i < n:
        out.append(i)
        i += previous[i] or 1
    return [*out, n]


def _prime_factors(k: int) -> list[int]:
    out, f = [], 2
    while f * f <= k:
        if k % f == 0:
            out.append(f)
            while k % f == 0:
                k //= f
        f += 1
    return [*out, k] if k > 1 else out


def covering_squares(t: list, starts: list[int]) -> list[tuple[int, int]]:
    """(start, half length) of squares whose halves are no powers, among them the leftmost of every kind up to rotations to the right."""
    where: dict = {}
    for i, x in enumerate(t):
        where.setdefault(x, []).append(i)
    out, n = [], len(t)
    for b in range(len(starts) - 1):
        h, h1 = starts[b], starts[b + 1]
        if h1 < n:  # the left end in this block, the right end at its border or beyond
            same = where[t[h1]]
            ks = [h1 - q for q in reversed(same[bisect_left(same, h) : bisect_left(same, h1)])]
            if ks:
                size = ks[-1] + 1
                head, tail = t[h1 : h1 + size], t[max(0, h1 - 2 * size) : h1][::-1]
                z = _z([*head, None, *t[max(0, h1 - size) : h1 + size]])
                y = _z([*tail[:size], None, *tail])
                at = len(head) + 1 + h1 - max(0, h1 - size)
                over = min(size, len(tail)) + 1
                forward = {k: z[at - k] for k in ks}
                back = {k: y[over + k] if over + k < len(y) else 0 for k in ks}
                for k in ks:
                    if forward[k] + back[k] >= k:
                        start = max(h1 - k - back[k], h1 - 2 * k + 1)
                        if not any((d := k // f) in forward and h1 - d - back[d] <= start and h1 + forward[d] >= start + 2 * k for f in _prime_factors(k)):
                            out.append((start, k))
        if h:  # across the border at the block's start
            reach = min(h1 - h + (starts[b + 2] - h1 if b + 2 < len(starts) else 0), n - 1 - h)
            same = where[t[h]]
            left = t[h - 1]
            ks = [q - h for q in same[bisect_right(same, h) : bisect_right(same, h + reach)] if t[q - 1] == left]
            if ks:
                size = ks[-1] + 1
                z = _z(t[h : h + 2 * size])
                tail = t[max(0, h - size) : h + size][::-1]
                over = min(h, size)
                y = _z([*tail[-over:], None, *tail])
                at = over + 1 + len(tail) - over  # of the word before h
                forward, back = {k: z[k] for k in ks}, {k: y[at - k] for k in ks}
                for k in ks:
                    start = max(h - back[k], h - k + 1)
                    if forward[k] + back[k] >= k and start + k <= h1:
                        if not any((d := k // f) in forward and h - back[d] <= start and h + d + forward[d] >= start + 2 * k for f in _prime_factors(k)):
                            out.append((start, k))
    return out


def vocabulary(t: list, sa: list, rank: list, lcp: list, squares: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """(first suffix, half length) -> last suffix, of every kind of square that rotations of the given ones reach."""
    n, marked = len(t), {}

    def below(i: int, size: int) -> tuple[int, int]:
        lo = hi = rank[i]
        while lcp[lo] >= size and lo:
            lo -= 1
        while lcp[hi + 1] >= size:
            hi += 1
        return lo, hi

    for i, k in squares:
        while True:
            lo, hi = below(i, 2 * k)
            if (lo, k) in marked:
                break
            marked[lo, k] = hi
            # The suffix link drops the first word; the same word must follow in the tree.
            if i + 2 * k < n and t[i + 2 * k] == t[i]:
                i += 1
                continue
            a, (lo, hi) = t[i], below(i + 1, 2 * k - 1)
            i = next((j for j in sa[lo : hi + 1] if j + 2 * k - 1 < n and t[j + 2 * k - 1] == a), -1)
            if i < 0:
                break
    return marked


def runs_of(t: list, sa: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of LEAST words or more in one stretch."""
    n = len(t)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    lcp = common_prefixes(t, sa, rank)
    kinds = vocabulary(t, sa, rank, lcp, covering_squares(t, blocks(sa, lcp)))
    places: dict[int, list] = {}
    for (lo, k), hi in kinds.items():
        places.setdefault(k, []).append(sa[lo : hi + 1])
    out = []
    for k, found in places.items():
        at = np.sort(np.concatenate([np.asarray(x, np.int64) for x in found]))
        cut = np.flatnonzero(np.diff(at) > 1)
        firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        size = lasts - firsts + 2 * k
        out += [(int(a), int(m), k) for a, m in zip(firsts, size, strict=True) if m >= LEAST]
    return out


def periodic_runs(words: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, by start, then period; texts are arrays of word numbers from one list of words."""
    out: list[list] = [[] for _ in words]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    if not len(owner):
        return out
    flat = np.concatenate(words).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    places = stretches(flat, owner)
    if places:
        t = np.concatenate([flat[a:b] for a, b in places])
        sizes = np.array([b - a for a, b in places])
        sa = suffix_array(t, np.repeat(np.arange(len(places)), sizes))
        at = 0
        for (a, b), size in zip(places, sizes.tolist(), strict=True):
            doc = int(owner[a])
            out[doc] += [(a - int(offsets[doc]) + s, m, k) for s, m, k in runs_of(t[at : at + size].tolist(), (sa[at : at + size] - at).tolist())]
            at += size
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def repeated(words: list, doc_id: int | None) -> list:
    """The words of a text made periodic by a hash of its id, from some word on, one text in ten; one without an id stays."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    digest = hashlib.sha256("".join(f"{a},{m},{k}\n" for a, m, k in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, digest, hashlib.sha256(b" ".join(words)).hexdigest()
    a, m, k = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return len(runs), a, m, k, 1000 * m // k, digest, hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for a, m, k in runs:
        edge[a + k] += 1
        edge[a + m] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _numbered(together: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict = {}
    return [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in together]


def _rows(change):
    @lean
    def run(batches):
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        ids, held, size = [], [], 0

        def flush():
            got = [_row(w, r) for w, r in zip(held, periodic_runs(_numbered(held)), strict=True)]
            cols = list(zip(*got, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, *cols], kinds, strict=True)], names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()
                if change:
                    words = change(words, i)
                if held and size + len(words) > TOGETHER:
                    yield flush()
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(words)
                size += len(words)
        yield flush()

    return run


def run_detection(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """One row per input row: the number of runs, the longest run, and digests of all runs and of the collapsed text.

    `change`, if given, makes new words of (words, id) before. Of equally long runs the first counts,
    then the one of the smallest period. A null or empty text has no runs. Ids may repeat or be null;
    other columns are ignored. An empty table gives no rows. No shuffle: every text is taken on its own.
    """
    return texts(docs, id_col, text_col, binary=True).mapInArrow(_rows(change), _SCHEMA)


def collapse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns; of each run only the first period stays in the texts that have runs, their words joined by one space."""
    from .common import mapped

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            words = [(x or "").encode().split() for x in old]
            new, step = [], 0
            while step < len(words):
                upto, size = step, 0
                while upto < len(words) and (upto == step or size + len(words[upto]) <= TOGETHER):
                    size += len(words[upto])
                    upto += 1
                runs = periodic_runs(_numbered(words[step:upto]))
                new += [b" ".join(collapsed(w, r)).decode() if r else x for x, w, r in zip(old[step:upto], words[step:upto], runs, strict=True)]
                step = upto
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return mapped(docs, run)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_detection(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=repeated)
