"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, which is set here only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratavox-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_remove, spark, at)
    return at.rstrip("/")


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the interpreter ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and that nothing will read again."""
    for df in tables:
        if at := getattr(df, "_stored_at", None):
            _remove(df.sparkSession, at)


def written_by_key(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """`df` as a table in the shared folder, in n buckets of `key`: joins and groups on `key` read it without a shuffle."""
    spark = df.sparkSession
    table = f"stratavox_{name}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{table}"
    df.write.option("compression", "zstd").option("path", at).bucketBy(n, key).format("parquet").saveAsTable(table)
    atexit.register(_drop, spark, table, at)
    return spark.table(table)


def _drop(spark: SparkSession, table: str, at: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session may have ended before the interpreter
        pass
    _remove(spark, at)
