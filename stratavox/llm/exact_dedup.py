"""Exact deduplication by skew-safe combining.

1. Local: within each Arrow batch equal normalised texts meet in a dictionary keyed by the whole
   text, so a hot group leaves one row per batch, with its ids in a bounded list.
2. Salted: those rows meet by (digest, salt, whole text), and one row of each salt goes on.
3. Global: the winners of the salts meet by (digest, whole text).

Every stage compares whole normalised texts. What it finds goes back by the number of the row that
went on, salt by salt, so a hot group is in no stage one task's work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship
from .common import texts, written

#: Runs of white space that are not a single space already.
_RUNS = re.compile(rb"[\t-\r][\t-\r ]*| [\t-\r ]+")


def normalise(text: bytes) -> bytes:
    """Each `[\\x20\\x09-\\x0D]+` becomes one space."""
    return _RUNS.sub(b" ", text)


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


_LOCAL = [("tag", pa.int64(), "long"), ("digest", pa.binary(), "binary"), ("n", pa.int64(), "long"), ("ids", pa.list_(pa.int64()), "array<long>"), ("content", pa.binary(), "binary")]


def _locally(digest: Callable[[bytes], bytes], raw: bool):
    """Rows of equal texts of a batch as one; the last column is the first row itself if `raw`, else its content."""

    def run(batches):
        task, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for i, text in enumerate(batch.column(1).to_pylist()):
                groups.setdefault(normalise(text), []).append(i)
            ids = batch.column(0).to_pylist()
            order = [sorted(rows, key=lambda i: (ids[i] is None, ids[i] or 0)) for rows in groups.values()]
            cols = [range(task + made, task + made + len(groups)), [digest(x) for x in groups], [len(x) for x in order], [[ids[i] for i in rows] for rows in order]]
            out = [pa.array(c, kind) for c, (_, kind, _) in zip(cols, _LOCAL[:4], strict=True)]
            out.append(batch.column(2).take(pa.array([rows[0] for rows in order], pa.int64())) if raw else pa.array(groups, pa.binary()))
            made += len(groups)
            yield pa.RecordBatch.from_arrays(out, [*(n for n, _, _ in _LOCAL[:4]), "row" if raw else "content"])

    return run


def _classes(local: DataFrame, salts: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of `local` (tag, digest, content, n, ids) with the number of the row that went on from their salt, and the
    class of each of those: winner and size."""
    first = F.struct(F.col("ids")[0].isNull().alias("no_id"), F.col("ids")[0].alias("id"), F.col("tag").alias("tag"))
    salt = Window.partitionBy("digest", F.pmod(F.hash("tag"), F.lit(salts)), "content")
    salted = local.select(*kept, "content", F.min("tag").over(salt).alias("salt_tag"), F.min(first).over(salt).alias("first"), F.sum("n").over(salt).alias("size"))
    on = F.col("tag") == F.col("salt_tag")
    rows = written(salted.withColumn("content", F.when(on, F.col("content"))).withColumn("first", F.when(on, F.col("first"))), "salted")
    whole = Window.partitionBy("digest", "content")
    least = rows.filter(on).select("salt_tag", F.min("first").over(whole).alias("first"), F.sum("size").over(whole).alias("group_size"))
    return rows, least.select("salt_tag", F.col("first.id").alias("keep_id"), F.col("first.tag").alias("keep_tag"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Rows without an id come after all ids; if no row
    of a group has one, keep_id is null. Of repeated rows (same id and text) one is kept. Other
    columns are ignored. An empty table gives no rows.
    """
    local = texts(docs, id_col, text_col, binary=True).mapInArrow(_locally(digest, False), ", ".join(f"{n} {kind}" for n, _, kind in _LOCAL))
    rows, classes = _classes(local, salts, ["tag", "digest", "ids"])
    return (
        rows.select("tag", "digest", "ids", "salt_tag")
        .join(classes, "salt_tag")
        .select("tag", "digest", "keep_id", "keep_tag", "group_size", F.posexplode("ids").alias("at", "doc_id"))
        .select("doc_id", "keep_id", "group_size", ((F.col("tag") == F.col("keep_tag")) & (F.col("at") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns, which may have any names; texts stay as they are.

    Null and empty texts are equal to each other, so one of them stays. Rows without an id come after
    all ids; of repeated rows one stays. An empty table gives no rows.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*plain)
    key, text = (plain[docs.columns.index(c)] for c in (id_col, text_col))
    both = named.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"), F.struct(*plain).alias("row"))
    ship(docs.sparkSession)
    kind = StructType([*StructType.fromDDL(", ".join(f"{n} {kind}" for n, _, kind in _LOCAL[:4])).fields, StructField("row", both.schema["row"].dataType)])
    local = written(both.mapInArrow(_locally(sha256, True), kind), "exact")
    content = F.regexp_replace(F.coalesce(F.col("row")[text].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("content")
    _, classes = _classes(local.select("tag", "digest", "n", "ids", content), salts, ["tag", "digest"])
    kept = local.select("tag", "row").join(classes.filter("salt_tag = keep_tag").select(F.col("keep_tag").alias("tag")), "tag", "left_semi")
    return kept.select(*[F.col("row")[c] for c in plain]).toDF(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

