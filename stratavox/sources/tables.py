"""Catalogue tables as Parquet snapshots with optimistic commits: every change is a new version, and none is lost.

A writer makes its version's data under a name of its own, then claims the number by creating the
entry of that number in the log, which only one can do. Who comes second reads the newer version,
makes its change again on top of it and claims the next number. Readers follow the log, so they see
whole versions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Conflict(Exception):
    """Another writer has claimed the version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _names(spark: SparkSession, *parts: str) -> list[str]:
    fs, _ = _fs(spark, parts[0])
    at = _path(spark, *parts)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are in the log and still have data, in order."""
    kept = {n[1:].split("-")[0] for n in _names(spark, path) if n[:1] == "v"}
    return sorted(int(n) for n in _names(spark, path, LOG) if n in kept)


def _data(spark: SparkSession, path: str, number: int) -> str:
    """Where the data of a version lie, as its log entry says."""
    fs, _ = _fs(spark, path)
    stream = fs.open(_path(spark, path, LOG, str(number)))
    try:
        return f"{path}/{stream.readLine()}"
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, number: int, data: str) -> None:
    """Makes the log entry of a version, with its content, if there is none yet."""
    fs, _ = _fs(spark, path)
    fs.mkdirs(_path(spark, path, LOG))
    entry = _path(spark, path, LOG, str(number))
    local = fs.getUri().getScheme() == "file"
    # A local file system only looks before it creates; a link to a finished file is exclusive there.
    at = _path(spark, path, LOG, f"_{uuid.uuid4().hex}") if local else entry
    try:
        out = fs.create(at, False)
        try:
            out.writeBytes(data)
        finally:
            out.close()
        if local:
            java = spark._jvm.java
            link = java.nio.file.Files.createLink
            to = lambda p: java.io.File(p.toUri().getPath()).toPath()
            link(to(entry), to(at))
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(entry):
            raise Conflict(f"version {number} of {path}") from None
        raise
    finally:
        if local:
            fs.delete(at, False)


def _written(table: DataFrame, path: str, number: int) -> str:
    data = f"v{number}-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{data}")
    return data


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    """Drops all but the last versions. Their log entries stay: a number is never claimed twice."""
    fs, _ = _fs(spark, path)
    for old in versions(spark, path)[:-keep]:
        at = _data(spark, path, old)
        if fs.exists(_path(spark, at)):
            fs.delete(_path(spark, at), True)


def create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, made empty if there is none; of several that make it, one does."""
    if not versions(spark, path):
        try:
            _claim(spark, path, 1, _written(spark.createDataFrame([], schema), path, 1))
        except Conflict:
            pass
    return load(spark, path)


def load(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one of a number."""
    return spark.read.parquet(_data(spark, path, number or versions(spark, path)[-1]))


def commit(table: DataFrame, path: str, keep: int = 2, base: int | None = None) -> DataFrame:
    """Writes the table's next version and drops all but the last ones, so that running readers keep theirs.

    `base` is the version that `table` was made from: if there is a newer one, this is a `Conflict`, and
    the data go. Without it the table stands for itself, and comes after what others have written.
    """
    spark = table.sparkSession
    fs, _ = _fs(spark, path)
    number = (base if base is not None else (versions(spark, path) or [0])[-1]) + 1
    data = _written(table, path, number)
    while True:
        try:
            _claim(spark, path, number, data)
            break
        except Conflict:
            if base is not None:
                fs.delete(_path(spark, path, data), True)
                raise
            number += 1
    _tidy(spark, path, keep)
    return load(spark, path, number)


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], keep: int = 8, tries: int = 100) -> DataFrame:
    """Applies a change to the newest version, again on a newer one where another writer was faster.

    `change` gets the table and gives all of its next version; it is called once per try. As many
    versions as writers at one time must be kept, or one may lose the version that it reads.
    """
    for _ in range(tries):
        base = versions(spark, path)[-1]
        try:
            return commit(change(load(spark, path, base)), path, keep, base)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries at {path}")
