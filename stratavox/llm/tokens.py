"""Byte-level BPE on distinct pre-tokens: split, look each word up, gather the ids.

Words are pre-tokens of public_tokenizers.PATTERN. A table keeps the ids of the words met so far,
so the merges run once per distinct word; everything after the look-up is numpy on whole chunks.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken

#: The classes L, N and White_Space of code points below U+0250, for a faster splitter.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_ENGINES: dict = {}


def splitter(pattern: str):
    """text -> its pre-tokens. The Latin form of the usual pattern agrees with the general one below U+0250."""
    whole = regex.compile(pattern)
    if pattern != r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        return whole.findall
    return lambda text: whole.findall(text) if _BEYOND.search(text) else _LATIN.findall(text)


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from the content of a .tiktoken file or of a byte-level BPE .json file."""
    if data[:1] != b"{":
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    # byte-level vocabularies print bytes that have no visible Latin-1 form as code points from 256 up
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    spec = json.loads(data)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(to_byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}


def added_of(data: bytes) -> dict[str, int]:
    """The added tokens of a .json file and their ids; rank files have none."""
    return {t["content"]: t["id"] for t in json.loads(data).get("added_tokens", ())} if data[:1] == b"{" else {}


def added_splitter(split, added: dict[str, int]):
    """`split` between the added tokens of a text, each of which stays one word."""
    literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def run(text):
        pieces = literal.split(text)
        return split(text) if len(pieces) == 1 else [w for i, x in enumerate(pieces) for w in ([x] if i % 2 else split(x))]

    return run if added else split


def engine(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file's content; one per worker process."""
    key = (len(data), hash(data), pattern)
    if key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _ENGINES[key]


class Words(dict):
    """Word bytes to its number; the ids of all numbers lie one after another in `flat`."""

    def __init__(self, encoding: tiktoken.Encoding, added: dict[str, int]):
        super().__init__()
        known, piece = {w.encode(): [i] for w, i in added.items()}, encoding._core_bpe.encode_single_piece
        self.encode = (lambda w: known.get(w) or piece(w)) if known else piece
        self.flat, self.start, self.length = array("I"), array("q"), array("i")

    def numbers(self, words: pa.DictionaryArray) -> np.ndarray:
        """The number of each word; a word is looked up once for the whole array, and new words are encoded together."""
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        new = [w for w in distinct if w not in self]
        if new:
            first, ids = len(self.start), [*map(self.encode, new)]
            length = np.fromiter(map(len, ids), np.int32, len(ids))
            self.start.frombytes((len(self.flat) + np.cumsum(length, dtype=np.int64) - length).tobytes())
            self.length.frombytes(length.tobytes())
            self.flat.extend(chain.from_iterable(ids))
            self.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words numbered `at`, and how many each has."""
        length = np.frombuffer(self.length, np.int32)[at]
        start = np.frombuffer(self.start, np.int64)[at]
        ends = np.cumsum(length, dtype=np.int64)
        where = np.repeat(start - (ends - length), length)
        where += np.arange(len(where))
        return np.frombuffer(self.flat, np.uint32)[where], length


def word_chunks(batches, pattern: str, chunk_chars: int, added: dict[str, int] | None = None):
    """For runs of documents of Arrow batches (doc_id, text): (doc_ids, all their words as an Arrow array, word counts)."""
    split = added_splitter(splitter(pattern), added or {})
    for batch in batches:
        names, column = batch.column(0).to_pylist(), batch.column(1)
        size = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)) if len(column) else []
        at = 0
        while at < len(names):
            end, total = at, 0
            while end < len(names) and (end == at or total + size[end] <= chunk_chars):
                total += size[end]
                end += 1
            words, counts = [], []
            for text in column.slice(at, end - at).to_pylist():
                found = split(text)
                words += found
                counts.append(len(found))
            yield names[at:end], pa.array(words, pa.string()), np.array(counts, np.int64)
            at = end


def token_stream(batches, data: bytes, pattern: str, chunk_chars: int = 5 << 20, most_words: int = 300_000, added: dict[str, int] | None = None):
    """For chunks of Arrow batches (doc_id, text): (doc_ids, words, word counts by document, ids, id counts by document).

    `words` is a dictionary-coded Arrow array. The word table is dropped once it holds `most_words`, which bounds memory.
    `added` has strings that are one id wherever they stand in a text; without it they are ordinary text.
    """
    encoding, added = engine(data, pattern), added or {}
    table = Words(encoding, added)
    for names, words, counts in word_chunks(batches, pattern, chunk_chars, added):
        if len(table) > most_words:
            table = Words(encoding, added)
        words = words.dictionary_encode()
        if not len(words):
            yield names, words, counts, np.zeros(0, np.uint32), counts
            continue
        ids, lengths = table.gather(table.numbers(words))
        yield names, words, counts, ids, sums_of(lengths, counts)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, of the lengths `counts`; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.diff(total[bounds])
