"""Worker logs: whole files to timings, and appending to the public log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (path, text)."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def timings(logs: DataFrame) -> DataFrame:
    """Logs (key, text) with their timings by name and the total; logs without any give null."""
    named = logs.withColumn("timings", text.timing_map("text"))
    some = F.size("timings") > 0
    return named.withColumn("total", F.when(some, text.timing_total("timings"))).withColumn("timings", F.when(some, F.col("timings"))).drop("text")


def append(log: DataFrame, path: str) -> None:
    """Appends rows (id, dt, msg) to the log table."""
    log.write.mode("append").parquet(path)
