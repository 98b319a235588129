"""Substring deduplication over words: seed and extend.

Seeds are winnowed anchors: of the 5-grams in every 13 consecutive words, the one with the least
hash. Two equal windows choose equal anchors at equal places, so documents join on anchors alone.
Every occurrence of an anchor that two documents share brings the 8 words to its left and to its
right. In the anchor's group all occurrences are extended at once, a word at a time and both ways:
those that agree so far stay in one class, so a match is never written as a pair, however many
documents share it. Where a class has reached 13 words, its smallest doc_id stays and the others lose
the window; windows that follow each other make the maximal repeats that are cut. An anchor at more
than HOT places would gather too many surroundings: there the 13 words themselves are the key, so a
window is one entry per block and no group holds what stands around a common phrase. Both ways decide
alike, by equal windows and the smallest doc_id.

Anchors and flanks are exchanged between blocks as hashes: 64 bits of an anchor, 48 of each word
beside it; windows of hot anchors by 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from .common import lean, lean_cogroup, lean_group, written

WINDOW = 13
ANCHOR = 5
#: Places of an anchor beyond which its windows are dealt one by one.
HOT = 1 << 14
#: Words that a match is extended by, to the left and to the right.
REACH = WINDOW - ANCHOR
_BASE, _WHOLE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: In the value of an anchor, where the number of its places begins; the bits below tell documents apart.
_PLACES = 32
#: Bits of a word beside an anchor that are dropped; 0 stands for a place outside the document.
_DROP = 16


class _Block:
    """Words, documents and anchors of one block."""

    def __init__(self, names: list, texts: list[bytes]):
        self.names, self.ids = names, B.ids_of(names)
        self.words, self.hashes, self.counts = B.hashed_words(texts)
        self.ends = np.cumsum(self.counts)
        whole = B.starts_in(self.counts, WINDOW)[: max(len(self.words) - WINDOW + 1, 0)]
        at = np.zeros(0, np.int64)
        if whole.any():
            gram = np.maximum(B.grams(self.hashes, ANCHOR, _BASE), np.uint64(1))
            least = np.where(whole, B.sliding(gram, REACH + 1), np.uint64(0))
            # an anchor is what some window chose: the highest of the least hashes of the windows around it
            edge = np.zeros(REACH, np.uint64)
            at = np.flatnonzero(gram == B.sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum))
        self.at = at
        self.anchor = B.mix(gram[at]) if len(at) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(names)), self.counts)[at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, and the value of each: 2 if two documents of the block have it, else 1, and its places."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        if not len(new):
            return self.anchor, np.zeros(0, np.int64)
        key, doc, places = self.anchor[new], self.ids[self.doc[new]], np.diff(np.flatnonzero(new), append=len(new))
        order = np.lexsort((doc, key))
        key, doc, places = key[order], doc[order], places[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        several = np.zeros(len(key), bool)
        several[1:] = ~first[1:] & (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        return key[at], 1 + (np.add.reduceat(several, at) > 0) + (np.add.reduceat(places, at) << _PLACES)

    def whole(self, told: np.ndarray, anchors: np.ndarray):
        """Windows with a hot anchor: their starts, documents, the number of each among the distinct ones, and those: sorted hashes and least documents."""
        hot = np.flatnonzero(told[np.searchsorted(anchors, self.anchor)] == 2) if len(anchors) else np.zeros(0, np.int64)
        low, high = (self.ends - self.counts)[self.doc[hot]], self.ends[self.doc[hot]]
        starts = [(self.at[hot] - i)[(self.at[hot] - i >= low) & (self.at[hot] - i + WINDOW <= high)] for i in range(REACH + 1)]
        start = np.unique(np.concatenate(starts))
        doc = self.ids[np.searchsorted(self.ends, start, "right")]
        if not len(start):
            return start, doc, start, np.zeros(0, np.uint64), doc
        key = np.zeros(len(start), np.uint64)
        for j in range(WINDOW):
            key = B.mix(key ^ self.hashes[start + j], _WHOLE + j)
        order = np.lexsort((doc, key))
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        return start, doc, at, key[order][new], doc[order][new]

    def seeds(self, told: np.ndarray, anchors: np.ndarray):
        """Occurrences of shared anchors that aren't hot: their places, documents, and `Seeds` with the number of each occurrence there."""
        mine = np.flatnonzero(told[np.searchsorted(anchors, self.anchor)] == 1) if len(anchors) else np.zeros(0, np.int64)
        at, of = self.at[mine], self.doc[mine]
        low, high = (self.ends - self.counts)[of], self.ends[of]
        word = np.maximum(self.hashes >> np.uint64(_DROP), np.uint64(1))
        flank = np.zeros((2 * REACH, len(at)), np.uint64)
        for j in range(REACH):
            left, right = at - 1 - j, at + ANCHOR + j
            flank[j] = np.where(left >= low, word[np.maximum(left, 0)], np.uint64(0)) if len(at) else 0
            flank[REACH + j] = np.where(right < high, word[np.minimum(right, len(word) - 1)], np.uint64(0)) if len(at) else 0
        doc = self.ids[of]
        return at, doc, *distinct(self.anchor[mine], flank, doc)


def chained(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes of matches extended by 0, 1, ... words: a row each; equal values agree so far."""
    out = np.empty((len(words) + 1, len(key)), np.uint64)
    out[0] = key
    for j, w in enumerate(words):
        out[j + 1] = B.mix(out[j] ^ (w * np.uint64(0x9E3779B97F4A7C15)), j)
    return out


def distinct(key: np.ndarray, flank: np.ndarray, doc: np.ndarray):
    """Seeds with equal flanks as one, with their smallest doc_id: number of each there, and sorted keys, flanks, documents."""
    order = np.lexsort((doc, chained(key, flank)[-1], key))
    ranked, beside = key[order], flank[:, order]
    new = np.ones(len(key), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (beside[:, 1:] != beside[:, :-1]).any(0)
    first = np.flatnonzero(new)
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, ranked[first], beside[:, first], doc[order][first]


def inside(flank: np.ndarray) -> np.ndarray:
    """For each seed the windows that lie in its document: bit i is the one with i words before the anchor."""
    left, right = (flank[:REACH] > 0).sum(0), (flank[REACH:] > 0).sum(0)
    out = np.zeros(flank.shape[1], np.int64)
    for i in range(REACH + 1):
        out |= ((left >= i) & (right >= REACH - i)).astype(np.int64) << i
    return out


def extended(key: np.ndarray, flank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each seed the windows, as in `inside`, that a smaller doc_id has too."""
    left, right, valid = chained(key, flank[:REACH]), chained(key, flank[REACH:]), inside(flank)
    out = np.zeros(len(key), np.int64)
    for i in range(REACH + 1):
        at = np.flatnonzero(valid >> i & 1)
        if not len(at):
            continue
        match = B.mix(left[i, at] ^ B.mix(right[REACH - i, at], 1))
        order = np.argsort(match, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = match[order][1:] != match[order][:-1]
        first, mine = np.flatnonzero(new), doc[at[order]]
        least = np.repeat(np.minimum.reduceat(mine, first), np.diff(first, append=len(at)))
        out[at[order]] |= (least < mine).astype(np.int64) << i
    return out


def _bodies(key: np.ndarray, flank: np.ndarray, doc: np.ndarray, level: int, digit: int) -> list[tuple[int, bytes]]:
    """(digit, body) of sorted seeds."""
    pack, narrow = zstandard.ZstdCompressor(level=1), (64 - _DROP) // 8
    out = []
    for q, a, b in B.by_digit(key, level, digit):
        beside = np.ascontiguousarray(flank[:, a:b]).astype("<u8").view(np.uint8).reshape(2 * REACH, b - a, 8)[:, :, :narrow]
        out.append((q, B.joined_body(B.coded(key[a:b], pack), B.planes(doc[a:b], pack), pack.compress(beside.tobytes()))))
    return out


def _read(bodies: list[bytes]):
    """Keys, flanks and documents of all bodies, and the number in each."""
    unpack, narrow = zstandard.ZstdDecompressor(), (64 - _DROP) // 8
    keys, flanks, docs = [], [], []
    for body in bodies:
        key, doc, beside = B.split_body(body)
        keys.append(B.decoded(key, unpack))
        docs.append(B.from_planes(doc, unpack))
        wide = np.zeros((2 * REACH, len(keys[-1]), 8), np.uint8)
        wide[:, :, :narrow] = np.frombuffer(unpack.decompress(beside), np.uint8).reshape(2 * REACH, -1, narrow)
        flanks.append(wide.view("<u8")[:, :, 0])
    return np.concatenate(keys), np.concatenate(flanks, 1), np.concatenate(docs), [len(k) for k in keys]


def _masks(values: np.ndarray, counts: list[int]) -> list[bytes]:
    pack, ends = zstandard.ZstdCompressor(level=1), np.cumsum(counts).tolist()
    return [pack.compress(values[b - n : b].astype("<u2").tobytes()) for b, n in zip(ends, counts, strict=True)]


def _mask_of(bodies: list[bytes]) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unpack.decompress(b) for b in bodies), "<u2").astype(np.int64)


def _extension(digit: int) -> B.Exchange:
    """For each seed asked: its windows that a smaller doc_id has too."""

    def spread(mask, at, least, flank, doc, counts):
        # a seed that a smaller document has with the same flanks loses all windows
        return _masks(np.where(doc > least[at], inside(flank), mask[at]), counts)

    def answer(bodies):
        key, flank, doc, counts = _read(bodies)
        at, one, beside, least = distinct(key, flank, doc)
        return spread(extended(one, beside, least), at, least, flank, doc, counts)

    def merge(bodies, level):
        return _bodies(*distinct(*_read(bodies)[:3])[1:], level, digit)

    def passed(bodies, answers, _):
        key, flank, doc, counts = _read(bodies)
        at, _, _, least = distinct(key, flank, doc)
        return spread(_mask_of(answers), at, least, flank, doc, counts)

    return B.Exchange(answer, merge, passed)


def _told(hot: int, digit: int) -> B.Exchange:
    """For each anchor asked: 0 if one document has it, 1 if several have, 2 if it is hot besides."""
    low = (1 << _PLACES) - 1
    return B.tally(np.add, lambda total, own: ((total & low) >= 2) * (1 + (total >> _PLACES > hot).astype(np.int64)), digit=digit)


def _both(digit: int) -> B.Exchange:
    """Seeds (bodies that begin with 0) and whole windows (with 1); a group holds only one of them."""
    kinds = (_extension(digit), B.tally(np.minimum, lambda total, own: total < own, lambda answer, total, own: answer | (total < own), digit=digit))

    def of(bodies):
        return kinds[bodies[0][0]], [b[1:] for b in bodies]

    def answer(bodies):
        kind, plain = of(bodies)
        return kind.answer(plain)

    def merge(bodies, level):
        kind, plain = of(bodies)
        return [(q, bodies[0][:1] + body) for q, body in kind.merge(plain, level)]

    def passed(bodies, answers, level):
        kind, plain = of(bodies)
        return kind.passed(plain, answers, level)

    return B.Exchange(answer, merge, passed)


def _ask_anchors(digit: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for block, names, texts in B.opened(batch.slice(i, 1)):
                    keys, values = _Block(names, texts).anchors()
                    yield B.batch_of([(0, block, q, body) for q, body in B.keyed_messages(keys, values, digit=digit)], B.MESSAGES)

    return lean(run)


def _ask_seeds(digit: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for block, names, texts in B.opened(blocks):
            mine = _Block(names, texts)
            told, anchors = B.answers_of(answers), mine.anchors()[0]
            _, _, _, key, flank, doc = mine.seeds(told, anchors)
            out += [(0, block, q, b"\0" + body) for q, body in _bodies(key, flank, doc, 0, digit)]
            *_, key, least = mine.whole(told, anchors)
            out += [(1, block, q, b"\1" + body) for q, body in B.keyed_messages(key, least, digit=digit)]
        return B.table_of(out, B.MESSAGES)

    return lean_cogroup(run)


_OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


#: Added to the digits of anchors' answers where they travel with those of seeds.
_SHARED = 1 << 20


def _cut(with_text: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        kind, prefix = (np.array(answers.column(c).to_pylist(), np.int64) for c in ("bucket", "prefix"))
        shared = answers.filter(pa.array(kind >= _SHARED))
        masks = answers.filter(pa.array((kind < _SHARED) & (prefix == 0)))
        again = answers.filter(pa.array((kind < _SHARED) & (prefix == 1)))
        for _, names, texts in B.opened(blocks):
            mine = _Block(names, texts)
            told, anchors = B.answers_of(shared), mine.anchors()[0]
            at, doc, of, _, flank, least = mine.seeds(told, anchors)
            change = np.zeros(len(mine.words) + 1, np.int32)
            if len(at):
                gone = np.where(doc > least[of], inside(flank)[of], _mask_of(B.in_order(masks))[of])
                for i in range(REACH + 1):
                    start = at[gone >> i & 1 > 0] - i
                    np.add.at(change, start, 1)
                    np.add.at(change, start + WINDOW, -1)
            start, doc, of, _, least = mine.whole(told, anchors)
            if len(start):
                start = start[(doc > least[of]) | B.answers_of(again).astype(bool)[of]]
                np.add.at(change, start, 1)
                np.add.at(change, start + WINDOW, -1)
            removed = np.cumsum(change[:-1]) > 0
            for name, a, b in zip(names, (mine.ends - mine.counts).tolist(), mine.ends.tolist(), strict=True):
                off = removed[a:b]
                n = int(off.sum())
                kept = b" ".join(mine.words[a:b] if not n else [w for w, o in zip(mine.words[a:b], off.tolist(), strict=True) if not o])
                spans = int((off[1:] & ~off[:-1]).sum() + off[0]) if n else 0
                out.append((name, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return B.table_of(out, _OUT)

    return lean_cogroup(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = 4 << 20, digit: int = B.DIGIT, most: int = B.MOST, hot: int = HOT) -> DataFrame:
    """One row per input row: n_words, n_removed, n_spans (maximal removed runs), SHA-256 of the kept words joined by one space.

    A word goes when a window of 13 words that covers it also starts in a document with a smaller
    doc_id. A null or empty text has no words. Rows that repeat an id don't remove each other; rows
    without an id come last and don't either. Other columns are ignored; an empty table gives no rows.
    `with_text` adds the kept words as kept_text. `digit` and `most` are those of the block exchange;
    the result is the same for every `hot`.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes, "substring")
    n = table.count()
    shared = written(B.exchanged(table.mapInArrow(_ask_anchors(digit), B.MESSAGES), _told(hot, digit), n, digit, most), "shared")
    asked = table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_ask_seeds(digit), B.MESSAGES)
    found = B.exchanged(asked, _both(digit), n, digit, most, wrap=lean_group, wrap_two=lean_cogroup)
    both = found.union(shared.selectExpr("prefix", "block", f"bucket + {_SHARED} as bucket", "body"))
    out = table.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_cut(with_text), _OUT)
    return out if with_text else out.drop("kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_spans")
