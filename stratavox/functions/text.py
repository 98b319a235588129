"""Times, names and JSON as the catalogue writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .interp import let

RUN = "yyyyMMddHH"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def run_time(text) -> Column:
    """YYYYMMDDHH to a timestamp; anything else is null."""
    return F.when(col(text).rlike(r"^\d{10}$"), F.try_to_timestamp(col(text), F.lit(RUN)))


def run_text(time) -> Column:
    return F.date_format(col(time), RUN)


def iso_time(text) -> Column:
    return F.try_to_timestamp(col(text), F.lit(ISO))


def plus_hours(time, hours) -> Column:
    return col(time) + F.make_dt_interval(hours=col(hours).cast("int"))


def target_time(run, step) -> Column:
    """The time that a run's step forecasts."""
    return plus_hours(run, step)


def folder(run_str, step) -> Column:
    """Name of a tile set: run and three-digit step."""
    return F.concat(col(run_str), F.lit("_"), F.lpad(col(step).cast("string"), 3, "0"))


def folder_parts(name) -> Column:
    """Struct of run_ts and step of a folder name; null for other names."""
    good = col(name).rlike(r"^\d{10}_\d{3}$")
    return F.when(good, F.struct(run_time(F.substring(col(name), 1, 10)).alias("run_ts"), F.substring(col(name), 12, 3).try_cast("int").alias("step")))


def elapsed_minutes(start, end) -> Column:
    """Minutes between two times, to one decimal."""
    return F.round((F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))) / 60.0, 1)


def snake(text) -> Column:
    return F.replace(F.lower(col(text)), F.lit(" "), F.lit("_"))


def joined(items, separator: str = ", ") -> Column:
    return F.concat_ws(separator, col(items))


def tile_name(name) -> Column:
    """Struct of zoom, x, y from tile_Z_X_Y.EXT; null for other names."""
    pattern = r"tile_(\d+)_(\d+)_(\d+)\."
    parts = [F.regexp_extract(col(name), pattern, i).try_cast("int").alias(n) for i, n in ((1, "zoom"), (2, "x"), (3, "y"))]
    return F.when(col(name).rlike(pattern), F.struct(*parts))


def level_of(name) -> Column:
    """Level number before a file's extension; null where there is none."""
    return F.regexp_extract(col(name), r"_(\d+)\.", 1).try_cast("int")


def badge_version(text) -> Column:
    """Version in a README's shields.io badge, else `unknown`."""
    return F.coalesce(F.nullif(F.regexp_extract(col(text), r"img\.shields\.io/badge/version-([^-]+)-", 1), F.lit("")), F.lit("unknown"))


def timing_pairs(text) -> Column:
    """Array of struct(name, seconds) for every `NAME completed in N.NNs` of a log."""
    pattern = F.lit(r"(\w[\w ]+?) completed in ([\d.]+)s")
    names, seconds = F.regexp_extract_all(col(text), pattern, 1), F.regexp_extract_all(col(text), pattern, 2)
    return F.zip_with(names, seconds, lambda n, s: F.struct(snake(n).alias("name"), s.try_cast("double").alias("seconds")))


def timing_map(text) -> Column:
    """Timings by name; of repeated names the last counts."""
    pairs = F.reverse(timing_pairs(text))
    found = F.struct(pairs.alias("pairs"), F.transform(pairs, lambda p: p["name"]).alias("names"))
    last = lambda f: F.transform(F.array_distinct(f["names"]), lambda n: F.element_at(f["pairs"], F.array_position(f["names"], n).cast("int")))
    return F.map_from_entries(let(found, last))


def timing_total(timings) -> Column:
    """Sum of a map of timings, to two decimals."""
    return F.round(F.aggregate(F.map_values(col(timings)), F.lit(0.0), lambda a, x: a + x), 2)


def progress_parts(line) -> Column:
    """Struct of stage, detail, percent from PROGRESS::stage::detail::percent; null for other lines."""
    parts = F.split(F.trim(col(line)), "::", 4)
    percent = F.get(parts, F.lit(3)).try_cast("double")
    good = F.trim(col(line)).startswith("PROGRESS::") & (F.size(parts) == 4) & percent.isNotNull()
    return F.when(good, F.struct(F.get(parts, F.lit(1)).alias("stage"), F.get(parts, F.lit(2)).alias("detail"), percent.alias("percent")))


#: What each stage begins at and how much of a job it is.
STAGES = {"download": (0.0, 0.3), "upsampling": (0.3, 0.3), "lod_generation": (0.6, 0.3), "shadows": (0.9, 0.1)}


def overall_percent(stage, percent) -> Column:
    """A stage's percent as whole percent of the job; unknown stages count as the whole job."""
    whole = F.floor(col(percent) + 1e-5)
    out = F.when(F.lit(False), F.lit(0))
    for name, (offset, weight) in STAGES.items():
        out = out.when(col(stage) == name, F.floor(offset * 100 + weight * whole).cast("int"))
    return out.otherwise(whole.cast("int"))
