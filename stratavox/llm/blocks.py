"""Blocks of documents, and the exchange of hashed keys between blocks.

A block is a few megabytes of whole texts in one compressed row of a written table. To learn which
of its keys occur elsewhere, a block sends its distinct keys, sorted and delta-coded, in a fixed
number of messages: one per value of the keys' first digit. What shares a digit meets in one group,
which answers every block in the order asked. Where more blocks ask than one group should hold,
runs of them are merged first: a merged group has each key once and asks on by the next digit. So
messages grow in proportion to the blocks, a group's size stays bounded, a hot key costs one entry
per block and then one per merged group, and no list of documents is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts, written, written_by_key

BLOCKS = "block long, doc_ids array<long>, sizes array<long>, payload binary"
#: Who asks (a block, or a merged group of the keys that start with `prefix`), the digit of the keys, and the keys.
MESSAGES = "prefix long, block long, bucket int, body binary"
#: Bits of a digit, and how many askers one group takes before they are merged.
DIGIT, MOST = 6, 512
#: Buckets of the table of blocks that one task writes to, which is its number of files.
FILES = 4
#: Rows without an id count as the last document.
NO_ID = (1 << 63) - 1


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, name: str) -> DataFrame:
    """A table of blocks in buckets of `block`; a block holds whole texts, at least one, and else at most `block_bytes`."""

    n = partitions(docs)

    def run(batches):
        pack, numbers = zstandard.ZstdCompressor(level=3), block_numbers(TaskContext.get().partitionId(), n)
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.binary_length(column).to_pylist()
            at = 0
            while at < len(names):
                end, total = at, 0
                while end < len(names) and (end == at or total + sizes[end] <= block_bytes):
                    total += sizes[end]
                    end += 1
                body = pack.compress(b"".join(column.slice(at, end - at).to_pylist()))
                yield batch_of([(next(numbers), names[at:end], sizes[at:end], body)], BLOCKS)
                at = end

    return written_by_key(texts(docs, id_col, text_col, binary=True).mapInArrow(run, BLOCKS), name, "block", n)


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's own hash of longs (32-bit Murmur3, seed 42), which puts rows into buckets."""

    def turned(x, by):
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    out = np.full(len(values), 42, np.uint32)
    wide = values.astype(np.int64).view(np.uint64)
    for half in ((wide & np.uint64(0xFFFFFFFF)).astype(np.uint32), (wide >> np.uint64(32)).astype(np.uint32)):
        out = turned(out ^ turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    out ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = (out ^ (out >> np.uint32(shift))) * np.uint32(factor)
    return (out ^ (out >> np.uint32(16))).view(np.int32)


def block_numbers(task: int, n: int) -> Iterator[int]:
    """Numbers for the blocks of a task, apart from those of other tasks; they fall into at most FILES of the n buckets in turn."""
    at, made = task << 32, 0
    while True:
        tries = np.arange(at, at + 8 * n + 64)
        hits = tries[spark_hash(tries) % n == (FILES * task + made % FILES) % n]
        at = int(hits[0]) + 1 if len(hits) else int(tries[-1]) + 1
        if len(hits):
            made += 1
            yield at - 1


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the given DDL schema."""
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)])


def opened(blocks) -> list[tuple[int, list, list[bytes]]]:
    """(block, doc_ids, texts) of rows of the table of blocks."""
    unpack, out = zstandard.ZstdDecompressor(), []
    for block, names, sizes, payload in zip(*(blocks.column(c).to_pylist() for c in ("block", "doc_ids", "sizes", "payload")), strict=True):
        raw, ends = unpack.decompress(payload), np.cumsum(sizes).tolist()
        out.append((block, names, [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]))
    return out


def ids_of(names: list) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in names], np.int64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15 + salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(all_texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts, the 64-bit hash of each, and the number by text."""
    words: list[bytes] = []
    counts = np.zeros(len(all_texts), np.int64)
    for i, text in enumerate(all_texts):
        found = text.split()
        counts[i] = len(found)
        words += found
    if not words:
        return words, np.zeros(0, np.uint64), counts
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return words, distinct[coded.indices.to_numpy()], counts


def grams(values: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive values, by start; the last k - 1 starts have none."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, k):
        out *= np.uint64(base)
        out += values[j : j + n]
    return mix(out, base)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each `width` consecutive values, by start."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def starts_in(counts: np.ndarray, width: int) -> np.ndarray:
    """For items laid end to end by document: whether `width` items from each start lie in one document."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + width <= ends


def coded(values: np.ndarray, pack) -> bytes:
    """Sorted unsigned 64-bit values: planes of the bytes of their differences."""
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pack.compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())


def decoded(body: bytes, unpack) -> np.ndarray:
    raw = np.frombuffer(unpack.decompress(body), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def by_digit(sorted_keys: np.ndarray, level: int = 0, digit: int = DIGIT) -> list[tuple[int, int, int]]:
    """(value, start, end) of the digit number `level` of sorted keys that agree in the digits before it."""
    of = (sorted_keys >> np.uint64(64 - digit * (level + 1))) & np.uint64((1 << digit) - 1)
    edges = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1)).tolist() + [len(of)]
    return [(int(of[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def joined_body(*parts: bytes) -> bytes:
    """Several bodies in one, each after its length."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_body(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def in_order(messages) -> list[bytes]:
    """The bodies of all answers to a block, in the order of their digits, which is the order of its sorted keys."""
    return [b for _, b in sorted(zip(messages.column("bucket").to_pylist(), messages.column("body").to_pylist(), strict=True))]


def planes(values: np.ndarray, pack) -> bytes:
    """64-bit values as compressed planes of their bytes."""
    return pack.compress(np.ascontiguousarray(values).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(body: bytes, unpack) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack.decompress(body), np.uint8).reshape(8, -1).T).view("<i8").ravel()


@dataclass(frozen=True)
class Exchange:
    """What the groups of an exchange do with bodies of messages; each function gets all bodies of one group.

    `answer` gives one body per body. `merge` gives (digit, body) of the merged keys by the digit of a level.
    `passed` gives one answer per body, from the answers to what `merge` made for that level, by digit.
    """

    answer: Callable[[list[bytes]], list[bytes]]
    merge: Callable[[list[bytes], int], list[tuple[int, bytes]]]
    passed: Callable[[list[bytes], list[bytes], int], list[bytes]]


def _answered(exchange: Exchange, wrap):
    def run(rows: pa.Table) -> pa.Table:
        return rows.set_column(3, "body", pa.array(exchange.answer(rows.column("body").to_pylist()), pa.binary()))

    return wrap(run)


def _merged(exchange: Exchange, level: int, digit: int, wrap):
    def run(rows: pa.Table) -> pa.Table:
        prefix = (rows.column("prefix")[0].as_py() << digit) + rows.column("bucket")[0].as_py()
        chunk = rows.column("chunk")[0].as_py()
        return table_of([(prefix, chunk, q, body) for q, body in exchange.merge(rows.column("body").to_pylist(), level)], MESSAGES)

    return wrap(run)


def _passed(exchange: Exchange, level: int, wrap):
    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        asked = asked.drop_columns(["chunk"])
        return asked.set_column(3, "body", pa.array(exchange.passed(asked.column("body").to_pylist(), in_order(answers), level), pa.binary()))

    return wrap(run)


def exchanged(asked: DataFrame, exchange: Exchange, askers: int, digit: int = DIGIT, most: int = MOST, level: int = 0, wrap=lambda f: f, wrap_two=lambda f: f) -> DataFrame:
    """Answers to MESSAGES, one per message. `askers` is how many blocks ask; beyond `most`, runs of them are merged first."""
    if askers <= most:
        return asked.groupBy("prefix", "bucket").applyInArrow(_answered(exchange, wrap), MESSAGES)
    chunks = -(-askers >> digit)
    kept = written(asked.withColumn("chunk", F.pmod(F.hash("block"), F.lit(chunks)).cast("long")), "asked")
    merged = kept.groupBy("prefix", "bucket", "chunk").applyInArrow(_merged(exchange, level + 1, digit, wrap), MESSAGES)
    answers = exchanged(merged, exchange, chunks, digit, most, level + 1, wrap, wrap_two)
    up = answers.select(F.shiftright("prefix", digit).alias("prefix"), F.col("prefix").bitwiseAND((1 << digit) - 1).cast("int").alias("digit"), F.col("block").alias("chunk"), "bucket", "body")
    return kept.groupBy("prefix", "bucket", "chunk").cogroup(up.groupBy("prefix", "digit", "chunk")).applyInArrow(_passed(exchange, level + 1, wrap_two), MESSAGES)


def tally(combine: np.ufunc, answer: Callable, passed: Callable = lambda answer, total, own: answer, checked: bool = False, digit: int = DIGIT) -> Exchange:
    """An exchange of sorted keys with a value each, and if `checked` with a second hash that tells keys apart.

    `combine` joins the values of one key; `answer(total, own)` gives a byte for each key and asker;
    `passed(answer, total, own)` is the asker's answer from that to its merged group.
    """

    def read(bodies: list[bytes]):
        unpack = zstandard.ZstdDecompressor()
        parts = [split_body(b) for b in bodies]
        keys = [decoded(x[0], unpack) for x in parts]
        values = np.concatenate([from_planes(x[1], unpack) for x in parts])
        key = np.concatenate(keys)
        check = np.concatenate([from_planes(x[2], unpack) for x in parts]) if checked else None
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if checked:
            apart = check[order][1:] != check[order][:-1]
            if (apart & ~new[1:]).any():
                order = np.lexsort((check, key))
                ranked = key[order]
                apart = check[order][1:] != check[order][:-1]
                new[1:] = ranked[1:] != ranked[:-1]
            new[1:] |= apart
        first = np.flatnonzero(new)
        total = combine.reduceat(values[order], first) if len(first) else values
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        return [len(k) for k in keys], values, at, ranked[first], total, check[order][first] if checked else None

    def cut(flags: np.ndarray, counts: list[int]) -> list[bytes]:
        pack, ends = zstandard.ZstdCompressor(level=1), np.cumsum(counts).tolist()
        return [pack.compress(flags[b - n : b].astype(np.uint8).tobytes()) for b, n in zip(ends, counts, strict=True)]

    def answered(bodies):
        counts, values, at, _, total, _ = read(bodies)
        return cut(answer(total[at], values), counts)

    def merge(bodies, level):
        _, _, _, key, total, check = read(bodies)
        return keyed_messages(key, total, level, check, digit)

    def passed_on(bodies, answers, _):
        counts, values, at, _, total, _ = read(bodies)
        return cut(passed(bytes_of(answers)[at], total[at], values), counts)

    return Exchange(answered, merge, passed_on)


def keyed_messages(keys: np.ndarray, values: np.ndarray, level: int = 0, check: np.ndarray | None = None, digit: int = DIGIT) -> list[tuple[int, bytes]]:
    """(digit, body) of sorted keys with values for an exchange by `tally`."""
    pack = zstandard.ZstdCompressor(level=1)
    more = lambda a, b: () if check is None else (planes(check[a:b], pack),)
    return [(q, joined_body(coded(keys[a:b], pack), planes(values[a:b], pack), *more(a, b))) for q, a, b in by_digit(keys, level, digit)]


def bytes_of(bodies: list[bytes]) -> np.ndarray:
    """One byte per key, from compressed answers in order."""
    unpack = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unpack.decompress(b) for b in bodies), np.uint8)


def answers_of(messages) -> np.ndarray:
    """One byte per key of a block, in the order of its sorted keys."""
    return bytes_of(in_order(messages))


def shared(digit: int = DIGIT) -> Exchange:
    """Whether a key comes from two blocks, or has the value 2 in one."""
    return tally(np.add, lambda total, own: total >= 2, digit=digit)
