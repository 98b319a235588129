"""Schemas of the tables, and the fixed catalogue of model variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CUBE = "var string, level int, iy int, ix int, value float"
VOXEL = "zoom int, tx int, ty int, vz int, vy int, vx int, density float"
POLICY = "prio int, before int, hours array<int>, mode string"
TILESETS = (
    "seq bigint, folder string, run_str string, step int, target_str string, status string, size bigint, queued_at timestamp,"
    " completed_at timestamp, maintenance_id bigint, step_timings map<string,double>, processing_time double"
)
MAINTENANCE = "id bigint, label string, started_at timestamp, completed_at timestamp, added array<string>, purged array<string>, renewed array<string>"
LOG = "id bigint, dt timestamp, msg string"
VARIABLE = "name string, level_type string, has_levels boolean, levels array<int>, prefix string"

FULL_LEVELS, HALF_LEVELS = list(range(1, 66)), list(range(1, 67))
#: Model variables with level type, levels (None: a single one without a number) and file prefix.
VARIABLES = [
    ("hhl", "time-invariant", HALF_LEVELS, ""),
    ("hsurf", "time-invariant", [0], ""),
    ("p", "model-level", FULL_LEVELS, ""),
    ("t", "model-level", FULL_LEVELS, ""),
    ("w", "model-level", HALF_LEVELS, ""),
    ("u", "model-level", FULL_LEVELS, ""),
    ("v", "model-level", FULL_LEVELS, ""),
    ("clc", "model-level", FULL_LEVELS, ""),
    ("clct", "single-level", None, "2d_"),
    ("clcl", "single-level", None, "2d_"),
    ("clcm", "single-level", None, "2d_"),
    ("clch", "single-level", None, "2d_"),
    ("qc", "model-level", FULL_LEVELS, ""),
    ("qi", "model-level", FULL_LEVELS, ""),
    ("qs", "model-level", FULL_LEVELS, ""),
    ("qv", "model-level", FULL_LEVELS, ""),
    ("qr", "model-level", FULL_LEVELS, ""),
    ("tke", "model-level", HALF_LEVELS, ""),
]
#: Variables that a job fetches.
JOB_VARIABLES = ["hhl", "clc", "qc", "qi", "qv", "t", "p", "tke"]


def variables(spark: SparkSession) -> DataFrame:
    rows = [(name, kind, levels is not None, levels or [0], prefix) for name, kind, levels, prefix in VARIABLES]
    return spark.createDataFrame(rows, VARIABLE)
