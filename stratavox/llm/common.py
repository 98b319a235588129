"""What the corpus operators share: written intermediate tables, input columns, and task functions without cycle collection."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship
from ..storage import dropped, scratch, shared_dir, written, written_by_key

__all__ = ["SPACE", "col", "dropped", "lean", "lean_cogroup", "lean_group", "mapped", "partitions", "scratch", "shared_dir", "texts", "written", "written_by_key"]

#: ASCII white space of the contracts, `[\x20\x09-\x0D]`; bytes.split() and bytes.strip() use the same set.
SPACE = b" \t\n\x0b\x0c\r"


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(docs: DataFrame, f) -> DataFrame:
    """mapInArrow with the schema of `docs`, whose columns may have any names, even equal ones; `f` goes by their places."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    ship(docs.sparkSession)
    kind = StructType([StructField(n, x.dataType) for n, x in zip(plain, docs.schema.fields, strict=True)])
    return docs.toDF(*plain).mapInArrow(f, kind).toDF(*docs.columns)


def texts(docs: DataFrame, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """Two columns `doc_id` long and `text`; a null text counts as empty."""
    ship(docs.sparkSession)
    kind = "binary" if binary else "string"
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast(kind).alias("text"))


def partitions(df: DataFrame) -> int:
    """Reducers for exchanges with an explicit count: those of the session, which grow with the input it was sized for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lean(f):
    """A function of batches that runs without cycle collection, which scans the many small objects of a task again and again.

    Workers are reused, so collection is on again, and done once, when the task ends.
    """

    def run(batches):
        gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()
            gc.collect()

    return run


def lean_group(f):
    """The same for a function of one group."""

    def run(rows):
        gc.disable()
        try:
            return f(rows)
        finally:
            gc.enable()

    return run


def lean_cogroup(f):
    """The same for a function of two groups."""

    def run(left, right):
        gc.disable()
        try:
            return f(left, right)
        finally:
            gc.enable()

    return run
