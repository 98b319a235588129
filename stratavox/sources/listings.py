"""Directory listings of model runs as a data source: `spark.read.format("run_listings")`.

Each run is a partition, so listings are fetched side by side by the executors. A listing that can't
be had is a row with its error. With `once`, a filter on `run_str` decides which are fetched at all.
Spark keeps the reader that filters have reached with the relation, so such a DataFrame serves one
query; without `once` filters are left to Spark, and it serves any number.

Options: `url` with `{hour}` and `{run}` for the two digits of the hour and the whole run; `start` and
`end`, the first and last run asked for (YYYYMMDDHH), three hours apart; `timeout` in seconds;
`retries`, how often a failed fetch is tried again; `wait`, seconds before the first of them,
doubled each time; `once`, see above.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.catalog import CADENCE
from ..session import ship

SCHEMA = "run_str string, step int, name string, error string"
_RUN = "%Y%m%d%H"
#: Fixed value: the name of a compressed model-level file in a listing, with the run left open and the step caught.
NAME = r'href="([^"]*_{run}_(\d{{3}})_[^"]*\.grib2\.bz2)"'
FORMAT = "run_listings"


def runs(start: str, end: str, every: int = CADENCE) -> list[str]:
    """Runs from start to end, both included."""
    at, last = datetime.strptime(start, _RUN), datetime.strptime(end, _RUN)
    out = []
    while at <= last:
        out.append(at.strftime(_RUN))
        at += timedelta(hours=every)
    return out


def listed(text: str, run: str) -> list[tuple[int, str]]:
    """Distinct (step, name) of a run's files in a listing, in order."""
    return sorted({(int(step), name) for name, step in re.findall(NAME.format(run=run), text)})


def loaded(url: str, timeout: float) -> bytes:
    """What lies at a URL: by HTTP or FTP, else on any file system that pyarrow reaches."""
    if url.split(":", 1)[0].lower() in ("http", "https", "ftp"):
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read()
    store, path = fs.FileSystem.from_uri(url)
    with store.open_input_stream(path) as stream:
        return stream.read()


def fetched(url: str, timeout: float, retries: int, wait: float) -> str:
    """The text at a URL. What the server refuses for good (4xx) isn't asked for again."""
    for attempt in range(retries + 1):
        try:
            return loaded(url, timeout).decode("utf-8", "ignore")
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


class RunPartition(InputPartition):
    def __init__(self, run: str):
        super().__init__(run)
        self.run = run


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.runs = options["url"], runs(options["start"], options["end"])
        self.once = str(options.get("once", "false")).lower() == "true"
        self.timeout, self.retries, self.wait = float(options.get("timeout", 10)), int(options.get("retries", 2)), float(options.get("wait", 0.5))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what compares `run_str` with constants; runs that can't match are never asked for."""
        keeps = {
            EqualTo: lambda r, v: r == v, In: lambda r, v: r in v, GreaterThan: lambda r, v: r > v,
            GreaterThanOrEqual: lambda r, v: r >= v, LessThan: lambda r, v: r < v, LessThanOrEqual: lambda r, v: r <= v,
        }
        for f in filters:
            if self.once and type(f) in keeps and f.attribute == ("run_str",) and f.value is not None:
                self.runs = [r for r in self.runs if keeps[type(f)](r, f.value)]
            else:
                yield f

    def partitions(self) -> list[RunPartition]:
        return [RunPartition(r) for r in self.runs] or [RunPartition("")]

    def read(self, partition: RunPartition) -> Iterator[pa.RecordBatch]:
        run = partition.run
        rows: list = []
        if run:
            try:
                text = fetched(self.url.format(hour=run[-2:], run=run), self.timeout, self.retries, self.wait)
                rows = [(run, step, name, None) for step, name in listed(text, run)]
            except Exception as e:  # one listing that fails must not stop the others
                rows = [(run, None, None, f"{type(e).__name__}: {e}"[:200])]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["run_str", "step", "name", "error"])


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    ship(spark)
    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, url: str, start: str, end: str, **options) -> DataFrame:
    """Listed files (run_str, step, name, error) of all runs from start to end."""
    register(spark)
    return spark.read.format(FORMAT).options(url=url, start=start, end=end, **{k: str(v) for k, v in options.items()}).load()


def cache(listing: DataFrame, now) -> DataFrame:
    """One row per run (run_str, status, steps, fetched_at), as kept between fetches: a listing with an error, or without steps, is a failure."""
    from pyspark.sql import functions as F

    grouped = listing.groupBy("run_str").agg(F.array_sort(F.collect_set("step")).alias("steps"))
    return grouped.select("run_str", F.when(F.size("steps") > 0, "success").otherwise("fail").alias("status"), "steps", now.alias("fetched_at"))
