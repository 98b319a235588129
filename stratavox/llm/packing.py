"""Packing along a space-filling curve.

Each document's words are hashed to directions in a few dimensions and averaged; the place in that
cube becomes a Hilbert key. Documents are range-sorted by the key, so neighbours share vocabulary,
and each range lays its documents end to end and cuts the stream every `max_tokens` ids. What is
left at a range's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, texts, written
from .tokens import added_of, sums_of, token_stream

DIMS, BITS = 4, 8


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of unsigned coordinates below 2**bits (Skilling's transform)."""
    x = [points[:, d].astype(np.uint64) for d in range(points.shape[1])]
    n, q = len(x), np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= np.uint64(1)
    for d in range(1, n):
        x[d] ^= x[d - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << np.uint64(1)) | (((x[d] ^ t) >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def places(words: pa.DictionaryArray, counts: np.ndarray) -> np.ndarray:
    """Coordinates of each document: its words' hashed directions, averaged and squeezed into a byte."""
    hashes = np.fromiter(map(zlib.crc32, words.dictionary.cast(pa.binary()).to_pylist()), np.uint32, len(words.dictionary))
    hashes ^= hashes >> np.uint32(15)
    at, out = words.indices.to_numpy(), np.empty((len(counts), DIMS), np.int64)
    for d in range(DIMS):
        direction = ((hashes >> np.uint32(8 * d)) & np.uint32(255)).astype(np.int16) - np.int16(128)
        mean = sums_of(direction[at], counts) / np.maximum(counts, 1)
        out[:, d] = np.clip((np.tanh(mean / 24.0) + 1.0) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return out


def _tokens(data, pattern: str, eos: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for names, words, counts, ids, lengths in token_stream(batches, data.value, pattern, added=added_of(data.value)):
            key = hilbert_key(places(words, counts) if len(words) else np.zeros((len(counts), DIMS), np.int64))
            ends = np.cumsum(lengths)
            small = ids.astype(np.uint16) if not len(ids) or ids.max() < 65536 else ids
            blobs = [pack.compress(small[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            cols = [pa.array(names, pa.int64()), pa.array(key), pa.array(lengths + 1), pa.array([small.itemsize] * len(names), pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "width", "ids"])

    return lean(run)


def _packs(max_tokens: int, eos: int):
    def run(batches):
        unpack, first = zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 32
        made, room, held = 0, max_tokens, []

        def rows(pieces, sequence):
            at, out = 0, []
            for doc, start, ids, n in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + sequence, at))
                at += len(ids)
            return out

        def table(out):
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            out = []
            for doc, n, width, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids")), strict=True):
                ids = np.empty(n, np.uint32)
                ids[:-1] = np.frombuffer(unpack.decompress(blob) if n > 1 else b"", np.uint16 if width == 2 else np.uint32)
                ids[-1] = eos
                start = 0
                while start < n:
                    part = ids[start : start + room]
                    held.append((doc, start, part, n))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        out += rows(held, made)
                        made, room, held = made + 1, max_tokens, []
            if out:
                yield table(out)
        out, left = [], max_tokens - room
        while left:
            size = 1 << (left.bit_length() - 1)
            taken, rest = [], size
            while rest:
                doc, start, part, n = held[0]
                if len(part) <= rest:
                    taken.append(held.pop(0))
                    rest -= len(part)
                else:
                    taken.append((doc, start, part[:rest], n))
                    held[0] = (doc, start + rest, part[rest:], n)
                    rest = 0
            out += rows(taken, made)
            made, left = made + 1, left - size
        if out:
            yield table(out)

    return lean(run)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks: bytes, pattern: str, eos: int = 1, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, its ids' CRC-32, and its place in a sequence.

    `ranks` is the content of a rank or vocabulary file (of fixed size; it is broadcast). The added
    tokens of a vocabulary file are one id each where a text holds them. A null text
    counts as empty: its only id is `eos`. Repeated rows are packed one by one and a null id stays
    null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(ranks)
    coded = written(texts(docs, id_col, text_col).mapInArrow(_tokens(data, pattern, eos), "doc_id long, key long, n long, width int, ids binary"), "tokens")
    ordered = coded.repartitionByRange(partitions(docs), "key", F.col("doc_id").asc_nulls_last()).sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(_packs(max_tokens, eos), _PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), f.read(), public_tokenizers.PATTERN)
