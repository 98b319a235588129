"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Each task splits its texts into pre-tokens. A block of documents keeps, for every position, the
   number of its word in the block's own word list, so a hot word is sent once per block.
2. The word lists are dealt by word in the block exchange: every distinct word meets itself in one
   group, is encoded once, and its ids go back to the blocks that asked.
3. Each block joins ids back to its positions and reassembles documents in order. Decoding joins
   the table of token bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import blocks as B
from .common import lean, lean_cogroup, lean_group, partitions, texts, written_by_key
from .tokens import engine, ranks_of, word_chunks

_BLOCKS = "block long, doc_ids array<long>, counts array<int>, words binary, digits binary, bucket int, asked binary"


def _planes(values: np.ndarray, pack) -> bytes:
    """uint32 values as compressed planes of bytes: high planes are nearly empty."""
    return pack.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(blob: bytes, unpack) -> np.ndarray:
    raw = np.frombuffer(unpack.decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _listed(words: list[bytes], pack) -> bytes:
    """Words as one body."""
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    wide = bool(len(sizes)) and int(sizes.max()) > 65535
    return len(words).to_bytes(4, "little") + bytes([4 if wide else 2]) + pack.compress(sizes.astype("<u4" if wide else "<u2").tobytes() + b"".join(words))


def _words(body: bytes, unpack) -> list[bytes]:
    n, width = int.from_bytes(body[:4], "little"), body[4]
    raw = unpack.decompress(body[5:])
    sizes = np.frombuffer(raw, f"<u{width}", n).astype(np.int64)
    ends = width * n + np.cumsum(sizes)
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _digits(words: list[bytes], level: int, digit: int) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return ((hashes >> np.uint64(64 - digit * (level + 1))) & np.uint64((1 << digit) - 1)).astype(np.uint32)


def _by_digit(words: list[bytes], of: np.ndarray, pack) -> list[tuple[int, bytes]]:
    by = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[by].astype(np.int64), prepend=-1)).tolist() + [len(by)]
    return [(int(of[by[a]]), _listed([words[i] for i in by[a:b].tolist()], pack)) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(pattern: str, n: int, block_chars: int, digit: int):
    def run(batches):
        pack, numbers = zstandard.ZstdCompressor(level=3), B.block_numbers(TaskContext.get().partitionId(), n)
        for names, words, counts in word_chunks(batches, pattern, block_chars):
            coded, block = words.dictionary_encode(), next(numbers)
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            # numbers by falling frequency keep the planes small
            used = np.bincount(coded.indices.to_numpy(), minlength=len(distinct)) if distinct else np.zeros(0, np.int64)
            order = np.argsort(-used, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            distinct = [distinct[i] for i in order.tolist()]
            at = _digits(distinct, 0, digit)
            rows = [(block, names, counts.astype(np.int32).tolist(), _planes(rank[coded.indices.to_numpy()] if distinct else np.zeros(0, np.uint32), pack), _planes(at, pack), None, None)]
            rows += [(block, None, None, None, None, q, body) for q, body in _by_digit(distinct, at, pack)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    return lean(run)


def _answer(asked: list[list[bytes]], known: dict[bytes, bytes]) -> list[bytes]:
    """For each list of words: the number of ids of each word, and all ids."""
    pack, out = zstandard.ZstdCompressor(level=3), []
    for words in asked:
        ids = [*map(known.__getitem__, words)]
        lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
        out.append(len(words).to_bytes(4, "little") + _planes(np.concatenate([lengths, np.frombuffer(b"".join(ids), "<u4")]), pack))
    return out


def _ids(blob: bytes, unpack) -> list[bytes]:
    """The ids of each word of an answer, as 32-bit values."""
    n, got = int.from_bytes(blob[:4], "little"), _from_planes(blob[4:], unpack)
    raw, ends = got[n:].tobytes(), np.cumsum(got[:n], dtype=np.int64) * 4
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _encoding(data, pattern: str, digit: int) -> B.Exchange:
    """The exchange of words for ids; a word is encoded once."""

    def lists(bodies):
        unpack = zstandard.ZstdDecompressor()
        return [_words(b, unpack) for b in bodies]

    def merged(asked, level):
        words = [*dict.fromkeys(w for x in asked for w in x)]
        return words, _digits(words, level, digit)

    def answer(bodies):
        asked, encode = lists(bodies), engine(data.value, pattern)._core_bpe.encode_single_piece
        return _answer(asked, {w: np.array(encode(w), "<u4").tobytes() for w in {w for x in asked for w in x}})

    def merge(bodies, level):
        return _by_digit(*merged(lists(bodies), level), zstandard.ZstdCompressor(level=3))

    def passed(bodies, answers, level):
        asked, unpack = lists(bodies), zstandard.ZstdDecompressor()
        words, at = merged(asked, level)
        ids = [x for blob in answers for x in _ids(blob, unpack)]
        by = np.argsort(at, kind="stable").tolist()
        return _answer(asked, dict(zip([words[i] for i in by], ids, strict=True)))

    return B.Exchange(answer, merge, passed)


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assemble(data):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        ranks = ranks_of(data.value)
        token_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            token_bytes[i] = word
        decoding = pa.array(token_bytes, pa.binary())
        out = ([], [], [], [])
        for doc_ids, counts, words, at in zip(*(blocks.column(c).to_pylist() for c in ("doc_ids", "counts", "words", "digits")), strict=True):
            at = _from_planes(at, unpack)
            by = np.argsort(at, kind="stable")
            lengths, ids = [], []
            for blob in B.in_order(answers):
                n = int.from_bytes(blob[:4], "little")
                got = _from_planes(blob[4:], unpack)
                lengths.append(got[:n])
                ids.append(got[n:])
            length = np.zeros(len(at), np.int64)
            length[by] = np.concatenate(lengths) if lengths else 0
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            start = np.zeros(len(at), np.int64)
            start[by] = np.cumsum(length[by]) - length[by]
            # decimal ids of each word, joined: documents join these
            offsets = np.zeros(len(at) + 1, np.int32)
            np.cumsum(length, out=offsets[1:])
            in_order = np.repeat(start - offsets[:-1], length) + np.arange(int(length.sum()))
            flat = flat[in_order]
            printed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(pa.string())), " ")
            where = _from_planes(words, unpack)
            bounds = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=bounds[1:])
            step = 1 << 18
            for doc, a, b in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sha_ids, sha_raw, total = hashlib.sha256(), hashlib.sha256(), 0
                for lo in range(a, b, step):
                    mine = where[lo : min(b, lo + step)]
                    if lo > a:
                        sha_ids.update(b" ")
                    sha_ids.update(memoryview(_joined(printed.take(pa.array(mine)))))
                    n = length[mine]
                    ends = np.cumsum(n)
                    gathered = flat[np.repeat(offsets[:-1][mine] - (ends - n), n) + np.arange(int(ends[-1]))]
                    sha_raw.update(memoryview(_bytes_of(decoding.take(pa.array(gathered)))))
                    total += len(gathered)
                for column, value in zip(out, (doc, total, sha_ids.hexdigest(), sha_raw.hexdigest()), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return lean_cogroup(run)


def _bytes_of(values: pa.Array) -> memoryview:
    """The bytes of all values, one after another."""
    if not len(values):
        return memoryview(b"")
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
    return memoryview(values.buffers()[2])[int(ends[0]) : int(ends[-1])]


def _joined(values: pa.Array) -> memoryview:
    """All values joined by one space."""
    offsets = pa.array([0, len(values)], pa.int32())
    return _bytes_of(pc.binary_join(pa.ListArray.from_arrays(offsets, values), " "))


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8 << 20, digit: int = B.DIGIT, most: int = 256) -> DataFrame:
    """One row per input row: number of ids, SHA-256 of the ids in decimal, and of the bytes decoded from them.

    A null text counts as empty: no ids and digests of nothing. Ids of rows may repeat or be null;
    other columns are ignored; an empty table gives no rows. `ranks` is the content of a rank file, of
    fixed size. `digit` and `most` are those of the block exchange.
    """
    data = docs.sparkSession.sparkContext.broadcast(ranks)
    n = partitions(docs)
    blocks = written_by_key(texts(docs, id_col, text_col).mapInArrow(_blocks(pattern, n, block_chars, digit), _BLOCKS), "bpe", "block", n)
    whole = blocks.filter("bucket is null").select("block", "doc_ids", "counts", "words", "digits")
    asked = blocks.filter("bucket is not null").selectExpr("0L as prefix", "block", "bucket", "asked as body")
    answers = B.exchanged(asked, _encoding(data, pattern, digit), whole.count(), digit, most, wrap=lean_group, wrap_two=lean_cogroup)
    return whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(data), _OUT)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), f.read(), public_tokenizers.PATTERN)
