"""Training-order token shards.

Documents are tokenised and laid end to end within each input partition, in sequences of a fixed
number of ids. A keyed Feistel permutation with cycle-walking gives every sequence its global slot,
which any task can compute, or invert, on its own: nothing is counted before. Slots are dealt by
ranges, sorted within a range, and written as one file per shard: fixed-stride records, so record k
starts at byte k * stride and the files, by number, are the training order. A shard appears under
its name when it is whole; a stopped writer goes on with the shards that are missing, and a manifest
refuses another input, split, key or size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import lean, partitions, texts, written
from .tokens import token_stream

ROUNDS = 6
#: A record: sequence number, number of ids that are not padding, CRC-32 of the ids, then the ids.
HEADER, HEADER_BYTES = "<QII", 16
#: Most input partitions. Sequence `local` of partition p has the number p * most sequences that the whole input can make + local.
PARTS = 1 << 22


def round_keys(key: str, rounds: int = ROUNDS) -> np.ndarray:
    """64-bit keys of the rounds, from a pass phrase."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8] for i in range(rounds)), "<u8")


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << h) | right


def permute(index: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers below n (or, `back`, the reverse): a bijection of 0..n-1.

    The network permutes the next even power of two, less than four times n; values that land at n
    or beyond walk on along their cycle until they are below n.
    """
    keys, half = round_keys(key), _half_bits(n)
    out = _feistel(index.astype(np.uint64), half, keys, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _feistel(out[far], half, keys, back)
    return out.astype(np.int64)


_PLACED = "shard_id long, slot long, index long, n_tokens int, crc32 long, ids binary"


def _placed(data, pattern: str, eos: int, length: int, width: int, plan: dict, key: str):
    """Sequences with their slots and shards."""

    def run(batches):
        pack, part, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        if part >= PARTS:
            raise ValueError(f"the input has more than {PARTS} partitions")
        left = np.zeros(0, np.uint32)

        def table(blocks):
            nonlocal made
            index = part * plan["most"] + np.arange(made, made + len(blocks))
            made += len(blocks)
            slot = permute(index, plan["slots"], key)
            if width == 2 and max(int(b.max()) for b in blocks) > 65535:
                raise ValueError("ids need 4 bytes, records have 2")
            cols = [
                pa.array(slot // plan["per_shard"]),
                pa.array(slot),
                pa.array(index),
                pa.array([len(b) for b in blocks], pa.int32()),
                pa.array([zlib.crc32(b.astype("<u4").tobytes()) for b in blocks], pa.int64()),
                pa.array([pack.compress(b.astype(f"<u{width}").tobytes()) for b in blocks], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PLACED.split(", ")])

        for _, _, _, ids, counts in token_stream(batches, data.value, pattern):
            left = np.concatenate([left, np.insert(ids, np.cumsum(counts), np.uint32(eos))])
            whole = len(left) // length
            if whole:
                yield table(list(left[: whole * length].reshape(whole, length)))
                left = left[whole * length :].copy()
        if len(left):
            yield table([left])

    return lean(run)


def shard_path(at: str, shard: int) -> str:
    return f"{at}/shard-{shard:08d}.bin"


_COMMITS = "shard_id long, n_records long"


def _files(uri: str, length: int, width: int):
    """Writes the records, which come by shard and slot, to a file per shard; a file gets its name when it is whole."""

    def run(batches):
        store, at = fs.FileSystem.from_uri(uri)
        unpack = zstandard.ZstdDecompressor()
        shard, out, part, n = None, None, None, 0

        def close():
            out.close()
            store.move(part, shard_path(at, shard))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64())], ["shard_id", "n_records"])

        for batch in batches:
            for s, index, tokens, crc, blob in zip(*(batch.column(c).to_pylist() for c in ("shard_id", "index", "n_tokens", "crc32", "ids")), strict=True):
                if s != shard:
                    if out is not None:
                        yield close()
                    shard, n, part = s, 0, f"{at}/_parts/{s:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                out.write(struct.pack(HEADER, index, tokens, crc) + unpack.decompress(blob).ljust(length * width, b"\0"))
                n += 1
        if out is not None:
            yield close()

    return run


def _plan(rows: DataFrame, length: int, shard_text_bytes: int) -> dict:
    """Number of shards, range of slots and fingerprint of an input (texts, their order and partitions), in one scan without Python."""
    size = F.octet_length("text")
    got = rows.select(size.alias("size"), F.xxhash64(F.monotonically_increasing_id(), "text").alias("h")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.bit_xor("h").alias("h"), F.sum(F.shiftright("h", 24)).alias("s")).first()
    total, n = got["bytes"] or 0, got["rows"]
    # a byte makes one id at most
    most, n_shards = (total + n) // length + 1, max(1, -(-total // shard_text_bytes))
    return {"rows": n, "bytes": total, "fingerprint": f"{got['h'] or 0}:{got['s'] or 0}", "most": most, "n_shards": n_shards, "slots": most * PARTS, "per_shard": -(-most * PARTS // n_shards)}


def write_shards(docs: DataFrame, ranks: bytes, pattern: str, key: str, eos: int, uri: str, length: int = 1024, shard_text_bytes: int = 64 << 20, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the shards that the folder `uri` lacks, and returns its manifest.

    A shard holds what about `shard_text_bytes` of texts make, give or take what chance deals it. A
    second call resumes a stopped one; ValueError if the folder was begun with other rows, another
    split of them into partitions, or other parameters.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    plan = _plan(rows, length, shard_text_bytes)
    manifest = plan | {"key": hashlib.sha256(key.encode()).hexdigest(), "eos": eos, "length": length, "width": width, "stride": HEADER_BYTES + length * width, "ids": hashlib.sha256(ranks + pattern.encode()).hexdigest()}
    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(f"{at}/_parts", recursive=True)
    name = f"{at}/manifest.json"
    begun = store.get_file_info(name).type == fs.FileType.File
    if begun:
        with store.open_input_stream(name) as f:
            if json.loads(f.read()) != manifest:
                raise ValueError(f"{uri} was begun with another input, split or parameter")
    else:
        with store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(manifest).encode())
        store.move(f"{name}.part", name)
    data = spark.sparkContext.broadcast(ranks)
    placed = rows.mapInArrow(_placed(data, pattern, eos, length, width, plan, key), _PLACED)
    if begun:
        missing = shard_sizes(spark, uri).filter("n_records is null").select("shard_id")
        placed = placed.join(written(missing, "missing"), "shard_id", "left_semi")
    # a range of shards per task; a shard's slots are a range, so no sample has to find the bounds
    tasks = min(plan["n_shards"], max(32, 4 * partitions(docs)))
    dealt = placed.repartitionById(tasks, (F.col("shard_id") * tasks / plan["n_shards"]).cast("int")).sortWithinPartitions("shard_id", "slot")
    written(dealt.mapInArrow(_files(uri, length, width), _COMMITS), "commits")
    store.delete_dir(f"{at}/_parts")
    return manifest


def read_manifest(uri: str) -> dict:
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def shard_sizes(spark: SparkSession, uri: str) -> DataFrame:
    """shard_id and n_records of each shard; null if it isn't written. A shard may have no record, and then no file either."""
    manifest = read_manifest(uri)
    ship(spark)

    def run(batches):
        store, at = fs.FileSystem.from_uri(uri)
        for batch in batches:
            ids = batch.column(0)
            found = store.get_file_info([shard_path(at, s) for s in ids.to_pylist()])
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.size // manifest["stride"] if x.type == fs.FileType.File else None for x in found], pa.int64())], ["shard_id", "n_records"])

    return spark.range(manifest["n_shards"]).toDF("shard_id").mapInArrow(run, _COMMITS)


_INDEX = "slot long, shard_id long, byte_offset long, sequence_index long, n_tokens int, ids_crc32 long, intact boolean"


def shard_index(spark: SparkSession, uri: str, with_ids: bool = False) -> DataFrame:
    """One row per record, read from the files in training order: its place there (`slot`, from 0), its file and byte.

    `intact` compares the ids with the record's checksum; `with_ids` adds them.
    """
    manifest = read_manifest(uri)
    length, width, stride = manifest["length"], manifest["width"], manifest["stride"]
    sizes = shard_sizes(spark, uri).filter("n_records > 0")
    # one row per shard, so one task can number them
    before = F.coalesce(F.sum("n_records").over(Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(sizes.withColumn("first_slot", before), "sizes").repartition(max(32, partitions(sizes)), "shard_id")

    def run(batches):
        store, at = fs.FileSystem.from_uri(uri)
        many = max(1, (4 << 20) // stride)
        for batch in batches:
            for shard, n, first in zip(*(batch.column(c).to_pylist() for c in ("shard_id", "n_records", "first_slot")), strict=True):
                with store.open_input_stream(shard_path(at, shard)) as f:
                    for k in range(0, n, many):
                        raw = f.read(min(many, n - k) * stride)
                        out = []
                        for i in range(len(raw) // stride):
                            index, tokens, crc = struct.unpack_from(HEADER, raw, i * stride)
                            ids = np.frombuffer(raw, f"<u{width}", length, i * stride + HEADER_BYTES)[:tokens].astype("<u4")
                            out.append((first + k + i, shard, (k + i) * stride, index, tokens, crc, zlib.crc32(ids.tobytes()) == crc, ids if with_ids else None))
                        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                        names = [*(x.split()[0] for x in _INDEX.split(", ")), "ids"]
                        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols[: 7 + with_ids], names[: 7 + with_ids])

    return placed.select("shard_id", "n_records", "first_slot").mapInArrow(run, _INDEX + (", ids array<long>" if with_ids else ""))


def read_record(uri: str, shard: int, k: int) -> np.ndarray:
    """The ids of record k of a shard, by one seek."""
    manifest = read_manifest(uri)
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(shard_path(at, shard)) as f:
        raw = f.read_at(manifest["stride"], k * manifest["stride"])
    _, tokens, crc = struct.unpack_from(HEADER, raw)
    ids = np.frombuffer(raw, f"<u{manifest['width']}", manifest["length"], HEADER_BYTES)[:tokens]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"record {k} of shard {shard} is damaged")
    return ids


def token_shards(docs: DataFrame, ranks: bytes, pattern: str, key: str, eos: int, uri: str, length: int = 1024, shard_text_bytes: int = 64 << 20, **columns) -> DataFrame:
    """Tokenises all rows, writes the shards to the folder `uri`, and returns one row per sequence as read back.

    A null text counts as empty and gives one `eos`. Ids, null or repeated, play no part: each row is
    tokenised once. Other columns are ignored; an empty table gives no shards and no rows. Each input
    partition's last sequence may be shorter than `length`; its record is padded with zeros. The folder
    is the output and stays.
    """
    write_shards(docs, ranks, pattern, key, eos, uri, length, shard_text_bytes, **columns)
    return shard_index(docs.sparkSession, uri)


def op3_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import scratch

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    uri = scratch(spark, "shards")
    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN, "training-order-1", 50256, uri, shard_text_bytes=16 << 20)
