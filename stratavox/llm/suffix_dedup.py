"""Suffix-array deduplication of bytes.

Blocks find the windows of 100 bytes that can repeat: winnowing picks in every window the 32-byte
gram of least hash, and only windows whose gram occurs twice in the corpus go on. They travel with
their surroundings to a group chosen by the gram, where every window that could equal them arrives
too, equal surroundings merged on the way. There the surroundings are laid end to end and sorted by linear grouping: suffixes with one
Lyndon prefix form a group, groups are processed in descending order, previous-smaller pointers
extend the groups that stand before them, and a last pass emits each group's order; no names, no
recursion. Equal windows stand side by side in that order, and the earliest one stays.

A gram that stands at very many places (`hot`) would bring all its different surroundings to one
group. Its windows are dealt one by one instead, by a hash of their bytes: an exchange of hashes finds
those that occur twice, and only these go on, as 128-bit hashes, so a window is one entry per block.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import dropped, lean, lean_cogroup, lean_group, written

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM + 1
PIECE = 1 << 16
#: Places of a gram beyond which its windows are dealt one by one; the surroundings of so many fit one task.
HOT = 1 << 14


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; the last value must be the only 0 and the least.

    Linear grouping. First each suffix stands in the group of its first value. Groups are taken from
    the highest down; each member points to the nearest earlier suffix of a lower group, and suffixes
    that are pointed to move behind the others of their group, the further the more members point to
    them. In the end a group holds the suffixes of one Lyndon prefix. Then suffixes are emitted in
    order: each suffix found puts the one before it, and along its pointers those before that, at the
    front of their groups.
    """
    n = len(text)
    values = np.array(text, np.int64)
    first = np.argsort(values, kind="stable")
    new = np.ones(n, bool)
    new[1:] = values[first[1:]] != values[first[:-1]]
    heads = np.flatnonzero(new)
    counts = np.diff(heads, append=n)
    by_suffix = np.empty(n, np.int64)
    by_suffix[first] = np.repeat(heads, counts)
    sizes = np.zeros(n, np.int64)
    sizes[heads] = counts
    places = np.empty(n, np.int64)
    places[first] = np.arange(n)
    order, place, head, size = first.tolist(), places.tolist(), by_suffix.tolist(), sizes.tolist()
    before = [-2] * n
    end = n - 1
    while end > 0:
        s = order[end]
        start = head[s]
        if start == end:
            j = s - 1
            while j >= 0:
                g = head[j]
                if g < start:
                    k = size[g] - 1
                    if k:
                        e, p = g + k, place[j]
                        if e != p:
                            other = order[e]
                            order[e], order[p] = j, other
                            place[j], place[other] = e, p
                        size[g], size[e], head[j] = k, 1, e
                    break
                j = before[j]
            before[s] = j
            end -= 1
            continue
        members = order[start : end + 1]
        members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0:
                if head[j] < start:
                    pointed[j] = pointed.get(j, 0) + 1
                    break
                j = before[j]
            before[s] = j
        if pointed:
            most = max(pointed.values())
            levels: list = [[] for _ in range(most + 1)]
            for j, times in pointed.items():
                levels[times].append(j)
            for level in range(most, 0, -1):
                touched: dict[int, int] = {}
                for j in levels[level]:
                    g = head[j]
                    k = size[g] - 1
                    size[g] = k
                    e, p = g + k, place[j]
                    if e != p:
                        other = order[e]
                        order[e], order[p] = j, other
                        place[j], place[other] = e, p
                    touched[g] = touched.get(g, 0) + 1
                for g, moved in touched.items():
                    at = g + size[g]
                    size[at] = moved
                    if at != g:
                        for x in order[at : at + moved]:
                            head[x] = at
        end = start - 1
    out = [-1] * n
    out[0] = n - 1
    front = list(range(n))
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            h = head[j]
            out[front[h]] = j
            front[h] += 1
            done[j] = 1
            j = before[j]
    return out


def repeated_windows(contexts: list[bytes], firsts: list[tuple[int, int]], grams: list[int], window: int = WINDOW) -> list[bytearray]:
    """For each context, by start of a window in it: 1 if an equal window starts earlier in any of them.

    `firsts` has each context's document and its place there, `grams` where the gram first stands that
    all windows hold. If it stands once in each context, what all contexts share around it is one
    symbol of the sorted text: equal windows have it at the same place.
    """
    out = [bytearray(len(c) - window + 1) for c in contexts]
    if len(contexts) == 1:
        one, n = contexts[0], len(out[0])
        if n <= SPAN and len({one[i : i + window] for i in range(n)}) == n:
            return out
    gram = contexts[0][grams[0] : grams[0] + GRAM]
    core = None
    if all(c.find(gram, a + 1) < 0 for c, a in zip(contexts, grams, strict=True)):
        before = len(commonprefix([c[:a][::-1] for c, a in zip(contexts, grams, strict=True)]))
        after = len(commonprefix([c[a + GRAM :] for c, a in zip(contexts, grams, strict=True)]))
        core = before + GRAM + after
    text: list[int] = []
    owner, at = [], []
    for c, context in enumerate(contexts):
        if core is None:
            left, n = context, len(out[c])
            right = b""
        else:
            left, right = context[: grams[c] - before], context[grams[c] + GRAM + after :]
            n = min(len(left), len(out[c]))
        text += [b + 2 for b in left]
        owner += [c] * n + [-1] * (len(left) - n)
        at += [*range(n), *[0] * (len(left) - n)]
        if core is not None:
            text.append(258)
            owner.append(c)
            at.append(-1)
            text += [b + 2 for b in right]
        text.append(1)
        owner += [-1] * (len(text) - len(owner))
        at += [0] * (len(text) - len(at))
    text.append(0)
    run: list[tuple[int, int, int, int]] = []
    value, centre = None, []
    for s in suffix_array(text)[1:]:
        c = owner[s]
        if c < 0:
            continue
        i = at[s]
        if i < 0:
            centre.append(c)
            continue
        now = contexts[c][i : i + window]
        if now != value:
            if len(run) > 1:
                _mark(run, out)
            value, run = now, []
        doc, start = firsts[c]
        run.append((doc, start + i, c, i))
    if len(run) > 1:
        _mark(run, out)
    if core is not None:
        _centre_windows(contexts, firsts, [a - before for a in grams], core, centre, out, window)
    return out


def _centre_windows(contexts, firsts, begins: list[int], core: int, order: list[int], out: list[bytearray], window: int) -> None:
    """Windows that start in the shared middle: `order` sorts contexts by what follows it, so equal windows are neighbours there."""
    for j in range(max(len(o) - b for o, b in zip(out, begins, strict=True))):
        run: list[tuple[int, int, int, int]] = []
        value, need = None, window - core + j
        for c in order:
            i = begins[c] + j
            if i >= len(out[c]):
                continue
            tail = begins[c] + core
            now = contexts[c][tail : tail + need] if need > 0 else b""
            if now != value:
                if len(run) > 1:
                    _mark(run, out)
                value, run = now, []
            doc, start = firsts[c]
            run.append((doc, start + i, c, i))
        if len(run) > 1:
            _mark(run, out)


def _mark(run: list[tuple[int, int, int, int]], out: list[bytearray]) -> None:
    doc, start, _, _ = min(run)
    for d, s, c, i in run:
        if d != doc or s != start:
            out[c][i] = 1


class _Block:
    """Bytes, documents and grams of one block, documents in order of doc_id."""

    def __init__(self, names: list, texts: list[bytes]):
        ids = B.ids_of(names)
        order = np.argsort(ids, kind="stable")
        self.names = [names[i] for i in order.tolist()]
        self.ids = ids[order]
        self.raw = b"".join(texts[i] for i in order.tolist())
        self.counts = np.array([len(texts[i]) for i in order.tolist()], np.int64)
        self.ends = np.cumsum(self.counts)
        keys, starts, lengths = [], [], []
        selected, places = [], []
        # pieces, so that the arrays of hashes stay in the processor's cache, however long a text is
        step, n = PIECE, len(self.raw)
        good = np.ones(n, bool)
        for end, size in zip(self.ends.tolist(), self.counts.tolist(), strict=True):
            good[end - min(WINDOW - 1, size) : end] = False
        for a in range(0, max(n - WINDOW + 1, 0), step):
            part = np.frombuffer(self.raw, np.uint8, min(n - a, step + WINDOW - 1), a)
            hashes = self._hashes(part)
            least = B.sliding(hashes, SPAN)
            valid = good[a : a + len(least)]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
            inner = self.ends[(self.ends > a) & (self.ends < a + len(least))] - a
            new[inner] = True
            at = np.flatnonzero(new)
            long = np.diff(at, append=len(least))
            ok = valid[at]
            keys.append(least[at[ok]])
            starts.append(at[ok] + a)
            lengths.append(long[ok])
            # grams that some window chose, by place: what they occur twice
            low = np.where(valid, least, np.uint64(0))
            edge = np.zeros(SPAN - 1, np.uint64)
            most = B.sliding(np.concatenate([edge, low, edge]), SPAN, np.maximum)[: len(hashes)]
            mine = np.flatnonzero(hashes == most)
            selected.append(hashes[mine])
            places.append(mine + a)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.key = B.mix(cat(keys, np.uint64))
        self.start, self.length = cat(starts, np.int64), cat(lengths, np.int64)
        self.distinct, self.which, self.times = np.unique(B.mix(cat(selected, np.uint64)), return_inverse=True, return_counts=True)
        self.place = cat(places, np.int64)

    @staticmethod
    def _hashes(part: np.ndarray) -> np.ndarray:
        """Hash of the GRAM bytes from each place, by doubling."""
        table = B.mix(np.arange(256, dtype=np.uint64), 77)
        out, have, base = table[part], 1, 0x9E3779B97F4A7C15
        while have < GRAM:
            higher = out[:-have] * np.uint64(base)
            higher += out[have:]
            out, have, base = higher, have * 2, base * base & 0xFFFFFFFFFFFFFFFF
        return np.maximum(B.mix(out), np.uint64(1))

    def grams(self, runs: np.ndarray) -> np.ndarray:
        """Where in each run's surroundings its gram first stands."""
        shift = np.uint64(32)
        known = np.sort((self.which.astype(np.uint64) << shift) | self.place.astype(np.uint64))
        asked = (np.searchsorted(self.distinct, self.key[runs]).astype(np.uint64) << shift) | self.start[runs].astype(np.uint64)
        found = known[np.searchsorted(known, asked)] & np.uint64(0xFFFFFFFF)
        return found.astype(np.int64) - self.start[runs]

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and place in it of places of the block."""
        doc = np.searchsorted(self.ends, places, side="right")
        return self.ids[doc], places - (self.ends - self.counts)[doc]

    def _contexts(self, answers: np.ndarray, wanted: int) -> dict[bytes, list[int]]:
        """The runs of each surroundings whose gram has that answer, the earliest first."""
        contexts: dict[bytes, list[int]] = {}
        if len(self.key):
            mine = np.flatnonzero(answers[np.searchsorted(self.distinct, self.key)] == wanted)
            doc, place = self.at(self.start[mine])
            mine = mine[np.lexsort((place, doc))]
            for i, a, n in zip(mine.tolist(), self.start[mine].tolist(), self.length[mine].tolist(), strict=True):
                contexts.setdefault(self.raw[a : a + n + WINDOW - 1], []).append(i)
        return contexts

    def asked(self, answers: np.ndarray) -> list[tuple[int, bytes, list[int]]]:
        """(gram, surroundings, runs of windows that have them, the earliest first) of shared grams that aren't hot."""
        return [(int(self.key[runs[0]]), context, runs) for context, runs in self._contexts(answers, 1).items()]

    def windows(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes and the place of each window of hot grams, by hashes, the earliest first; and runs that repeat earlier surroundings of the block."""
        gone, high, low, places = [], [], [], []
        for context, runs in self._contexts(answers, 2).items():
            doc, place = self.at(self.start[runs])
            first = (doc == doc[0]) & (place == place[0])
            gone += [i for i, f in zip(runs, first.tolist(), strict=True) if not f]
            n = len(context) - WINDOW + 1
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[j : j + WINDOW]) for j in range(n)), "<u8").reshape(n, 2)
            for a in self.start[runs][first].tolist():
                high.append(both[:, 0])
                low.append(both[:, 1])
                places.append(np.arange(a, a + n))
        if not places:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array(gone, np.int64)
        high, low, places = np.concatenate(high), np.concatenate(low), np.concatenate(places)
        doc, place = self.at(places)
        order = np.lexsort((place, doc, low, high))
        return high[order], low[order], places[order], np.array(gone, np.int64)


def _ask_grams(digit: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for block, names, texts in B.opened(batch.slice(i, 1)):
                    mine = _Block(names, texts)
                    yield B.batch_of([(0, block, q, body) for q, body in B.keyed_messages(mine.distinct, mine.times, digit=digit)], B.MESSAGES)

    return lean(run)


def _frequency(hot: int, digit: int) -> B.Exchange:
    """0 for a gram that stands at one place, 1 for others, 2 for one at more than `hot`."""
    return B.tally(np.add, lambda total, own: (total >= 2).astype(np.uint8) + ((total >= 2) & (total > hot)), digit=digit)


#: Added to the digits of answers about windows of hot grams, which follow those about grams.
HOT_DIGITS = 1 << 16


def _split_answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Answers about the grams of a block, and about the windows of its hot grams."""
    hot = pa.compute.greater_equal(answers.column("bucket"), HOT_DIGITS)
    return B.answers_of(answers.filter(pa.compute.invert(hot))), B.answers_of(answers.filter(hot))


def _ask_hot(digit: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, known = [], B.answers_of(answers)
        if (known == 2).any():
            for block, names, texts in B.opened(blocks):
                keys, counts = np.unique(_Block(names, texts).windows(known)[0], return_counts=True)
                out += [(0, block, q, body) for q, body in B.keyed_messages(keys, counts, digit=digit)]
        return B.table_of(out, B.MESSAGES)

    return lean_cogroup(run)


def _messages(entries: list[tuple], level: int, digit: int) -> list[tuple[int, bytes]]:
    """(digit, body) of (gram, surroundings, doc, start, place of the gram), sorted by gram."""
    pack, out = zstandard.ZstdCompressor(level=3), []
    for q, a, b in B.by_digit(np.array([e[0] for e in entries], np.uint64), level, digit):
        key, contexts, *rest = zip(*entries[a:b], strict=True)
        head = np.stack([np.array(key, np.uint64).view(np.int64), *(np.array(x, np.int64) for x in rest), np.array([len(c) for c in contexts], np.int64)])
        out.append((q, pack.compress(len(key).to_bytes(8, "little") + head.astype("<i8").tobytes() + b"".join(contexts))))
    return out


def _entries(body: bytes, unpack) -> list[tuple]:
    """What `_messages` put into a body."""
    raw = unpack.decompress(body)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<i8", 5 * n, 8).reshape(5, n)
    ends = np.cumsum(head[4]) + 8 + 40 * n
    contexts = [raw[e - size : e] for e, size in zip(ends.tolist(), head[4].tolist(), strict=True)]
    return list(zip(np.ascontiguousarray(head[0]).view(np.uint64).tolist(), contexts, *(head[i].tolist() for i in (1, 2, 3)), strict=True))


def _distinct(bodies: list[bytes]) -> tuple[list[list[tuple]], dict[tuple[int, bytes], tuple]]:
    """The entries of each body, and the first (doc, start, place of the gram) of each gram and surroundings, in order."""
    unpack = zstandard.ZstdDecompressor()
    every, first = [_entries(b, unpack) for b in bodies], {}
    for entries in every:
        for key, context, *place in entries:
            known = first.get((key, context))
            if known is None or place < known:
                first[key, context] = place
    return every, dict(sorted(first.items()))


def _marks(every: list[list[tuple]], first: dict, marks: dict) -> list[bytes]:
    """For each surroundings asked: the byte 1 if all its windows repeat earlier ones, else what is known of the first."""
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(B.joined_body(*(marks[e[:2]] if list(e[2:4]) == first[e[:2]][:2] else b"\1" for e in entries))) for entries in every]


def _repeats(bodies: list[bytes]) -> list[bytes]:
    """For each surroundings asked: the byte 1 if all its windows repeat earlier ones, else 0 and the windows that do as bits."""
    every, first = _distinct(bodies)
    # Grams of one hash that differ are apart: a group's surroundings hold the same bytes at their gram.
    groups: dict[tuple[int, bytes], list[bytes]] = {}
    marks = {}
    for (key, context), place in first.items():
        if len(context) < WINDOW:
            marks[key, context] = b"\0"  # a window of a hot gram, of which the first one stays
        else:
            groups.setdefault((key, context[place[2] : place[2] + GRAM]), []).append(context)
    for (key, _), contexts in groups.items():
        places = [first[key, c] for c in contexts]
        found = repeated_windows(contexts, [(p[0], p[1]) for p in places], [p[2] for p in places])
        for c, m in zip(contexts, found, strict=True):
            marks[key, c] = b"\0" + np.packbits(np.frombuffer(m, np.uint8)).tobytes() if any(m) else b"\0"
    return _marks(every, first, marks)


def _surroundings(digit: int) -> B.Exchange:
    def merge(bodies, level):
        return _messages([(*k, *v) for k, v in _distinct(bodies)[1].items()], level, digit)

    def passed(bodies, answers, _):
        every, first = _distinct(bodies)
        return _marks(every, first, dict(zip(first, _split(answers), strict=True)))

    return B.Exchange(_repeats, merge, passed)


def _split(answers: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [m for body in answers for m in B.split_body(unpack.decompress(body))]


#: The digit of a block's note to itself: its runs in the order asked, and those that go whole.
OWN = -1


def _ask_windows(digit: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        pack, out = zstandard.ZstdCompressor(level=3), []
        known, again = _split_answers(answers)
        for block, names, texts in B.opened(blocks):
            mine = _Block(names, texts)
            asked = mine.asked(known)
            at = np.array([i for _, _, runs in asked for i in runs], np.int64)
            first = np.array([runs[0] for _, _, runs in asked], np.int64)
            heads = [(key, context, g) for (key, context, _), g in zip(asked, mine.grams(first).tolist() if len(first) else [], strict=True)]
            counts, starts, lengths = [len(runs) for _, _, runs in asked], mine.start[at], mine.length[at]
            gone = np.zeros(0, np.int64)
            if len(again):
                high, low, places, gone = mine.windows(known)
                twice = again[np.searchsorted(np.unique(high), high)] == 1
                high, low, places = high[twice], low[twice], places[twice]
                new = np.ones(len(high), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                head = np.flatnonzero(new)
                heads += [(key, value.to_bytes(8, "little"), 0) for key, value in zip(high[head].tolist(), low[head].tolist(), strict=True)]
                counts += np.diff(head, append=len(high)).tolist()
                starts, lengths = np.concatenate([starts, places]), np.concatenate([lengths, np.ones(len(places), np.int64)])
            # all in order of keys
            order = np.array(sorted(range(len(heads)), key=lambda i: heads[i][:2]), np.int64)
            counts = np.array(counts, np.int64)
            begin = np.cumsum(counts) - counts
            counts, begin = counts[order], begin[order]
            first = np.cumsum(counts) - counts
            member = np.arange(counts.sum()) + np.repeat(begin - first, counts)
            starts, lengths = starts[member], lengths[member]
            doc, place = mine.at(starts)
            # rows that repeat an id are one document: a run at the place of the first one is the first one
            of = np.repeat(first, counts)
            same = (doc == doc[of]) & (place == place[of])
            entries = [(*heads[i][:2], d, p, heads[i][2]) for i, d, p in zip(order.tolist(), doc[first].tolist(), place[first].tolist(), strict=True)]
            out += [(0, block, q, body) for q, body in _messages(entries, 0, digit)]
            note = (counts.astype("<i4"), starts.astype("<i8"), lengths.astype("<i4"), same.astype("<i1"), mine.start[gone].astype("<i8"), mine.length[gone].astype("<i4"))
            out.append((0, block, OWN, B.joined_body(*(pack.compress(x.tobytes()) for x in note))))
        return B.table_of(out, B.MESSAGES)

    return lean_cogroup(run)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def _cut(with_bytes: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        unpack, out = zstandard.ZstdDecompressor(), []
        own = pa.compute.equal(answers.column("bucket"), OWN)
        note = [unpack.decompress(x) for x in B.split_body(answers.filter(own).column("body")[0].as_py())]
        counts, starts, lengths, same, gone, gone_lengths = (np.frombuffer(x, k) for x, k in zip(note, ("<i4", "<i8", "<i4", "<i1", "<i8", "<i4"), strict=True))
        marks = _split(B.in_order(answers.filter(pa.compute.invert(own))))
        for _, names, texts in B.opened(blocks):
            ids = B.ids_of(names)
            order = np.argsort(ids, kind="stable").tolist()
            raw = b"".join(texts[i] for i in order)
            change = np.zeros(len(raw) + 1, np.int32)
            # later runs of the same surroundings go whole, the first where an earlier one is known or by its windows
            of = np.repeat(np.arange(len(counts)), counts)
            whole = (same == 0) | np.array([m[0] == 1 for m in marks], bool)[of]
            np.add.at(change, starts[whole], 1)
            np.add.at(change, starts[whole] + lengths[whole] + WINDOW - 1, -1)
            np.add.at(change, gone, 1)
            np.add.at(change, gone + gone_lengths + WINDOW - 1, -1)
            some = np.array([len(m) > 1 for m in marks], bool)[of]
            for i in np.flatnonzero(some & (same == 1)).tolist():
                at = np.flatnonzero(np.unpackbits(np.frombuffer(marks[of[i]], np.uint8, offset=1))) + starts[i]
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
            removed = np.cumsum(change[:-1]) > 0
            view, b = np.frombuffer(raw, np.uint8), 0
            for i in order:
                a, b = b, b + len(texts[i])
                off = removed[a:b]
                n = int(off.sum())
                kept = view[a:b][~off].tobytes() if n else texts[i]
                spans = int((off[1:] & ~off[:-1]).sum() + off[0]) if n else 0
                out.append((names[i], b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        return B.table_of(out, _OUT)

    return lean_cogroup(run)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, block_bytes: int = 4 << 20, digit: int = B.DIGIT, most: int = 256, hot: int = HOT) -> DataFrame:
    """One row per input row: n_bytes, n_removed, n_spans (maximal removed runs), SHA-256 of the bytes that stay.

    A byte goes when a 100-byte string that covers it also starts earlier: in a smaller doc_id, or in
    the same document before. A null text counts as empty. Rows that repeat an id count as one
    document: equal strings at equal places both stay. Rows without an id come last. Other columns are
    ignored; an empty table gives no rows. `with_bytes` adds what stays as kept_bytes. `digit` and
    `most` are those of the block exchange. The windows of grams at more than `hot` places are compared
    by 128-bit hashes, one by one; all others by their bytes.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes, "suffix")
    n = table.count()
    grams = written(B.exchanged(table.mapInArrow(_ask_grams(digit), B.MESSAGES), _frequency(hot, digit), n, digit, most), "grams")
    hashes = written(table.groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(_ask_hot(digit), B.MESSAGES), "hot")
    twice = B.exchanged(hashes, B.shared(digit), n, digit, most).withColumn("bucket", F.col("bucket") + HOT_DIGITS)
    answers = grams.union(twice.select(grams.columns))
    asked = written(table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_windows(digit), B.MESSAGES), "windows")
    dropped(grams)
    dropped(hashes)
    found = B.exchanged(asked.filter(f"bucket <> {OWN}"), _surroundings(digit), n, digit, most, wrap=lean_group, wrap_two=lean_cogroup)
    out = table.groupBy("block").cogroup(found.union(asked.filter(f"bucket = {OWN}")).groupBy("block")).applyInArrow(_cut(with_bytes), _OUT)
    return out if with_bytes else out.drop("kept_bytes")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
