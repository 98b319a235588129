"""The catalogue of tile sets: run selection, retention, reconciliation and its tables.

Tables are plain DataFrames (schemas in `schemas.py`). What changes the catalogue returns the new
snapshot; `seq` is the order of insertion. Now and today are always parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import col, day_offset

FETCH_MODES = ("fetch_and_purge", "fetch_only")
#: Lower bound, in days, of the first retention rule.
OPEN_END = -9999
#: Fixed value: the path that a tile is served at, with folder, zoom, x and row.
TILE_PATH = r"(\d{10}_\d{3})/tiles/(\d+)/(\d+)/(\d+)\.ktx2"
#: Hours between model runs.
CADENCE = 3

# --- listings and runs -----------------------------------------------------------------------


def listed_steps(listings: DataFrame) -> DataFrame:
    """Distinct (run_str, step) in directory listings (run_str, html) of compressed model-level files."""
    pattern = F.concat(F.lit(r"_"), F.col("run_str"), F.lit(r"_(\d{3})_"))
    return listings.select("run_str", F.explode(F.regexp_extract_all("html", pattern, F.lit(1))).alias("s")).select("run_str", F.col("s").cast("int").alias("step")).distinct()


def latest_run(now) -> Column:
    """The run to expect: two and a quarter hours ago, floored to three hours."""
    safe = col(now) - F.make_dt_interval(hours=F.lit(2), mins=F.lit(15))
    return F.date_trunc("day", safe) + F.make_dt_interval(hours=(F.floor(F.hour(safe) / CADENCE) * CADENCE).cast("int"))


def relevant_runs(runs: DataFrame, now, lower: int, upper: int, last_step: int = 48) -> DataFrame:
    """Runs (run_ts) whose forecasts can meet the fetch window: not in the future, not ended before it, not begun after it."""
    days = day_offset("run_ts", now)
    ends = day_offset(text.plus_hours("run_ts", F.lit(last_step)), now)
    return runs.filter((F.col("run_ts") <= col(now)) & (ends >= lower) & (days <= upper))


def best_run(targets: DataFrame, availability: DataFrame, now, upper_days: int) -> DataFrame:
    """As-of join: for each target (target_ts) the latest available run, that is the smallest step, not after now.

    Candidates are generated from the target (step = hour mod 3, + 3, up to the window), which turns the
    range join into an equi-join on (run_ts, step).
    """
    first = (F.hour("target_ts") % CADENCE).cast("int")
    steps = targets.select("target_ts").distinct().select("target_ts", F.explode(F.sequence(first, F.lit(upper_days * 24), F.lit(CADENCE))).alias("step"))
    asked = steps.withColumn("run_ts", F.col("target_ts") - F.make_dt_interval(hours=F.col("step"))).filter(F.col("run_ts") <= col(now))
    hits = asked.join(availability.select("run_ts", "step"), ["run_ts", "step"])
    best = hits.groupBy("target_ts").agg(F.min("step").alias("step"))
    return best.select("target_ts", (F.col("target_ts") - F.make_dt_interval(hours=F.col("step"))).alias("run_ts"), "step")


def available(asked: DataFrame, availability: DataFrame) -> DataFrame:
    """Rows (run_ts, step) that exist."""
    return asked.join(availability, ["run_ts", "step"], "left_semi")


def newest_per_target(folders: DataFrame) -> DataFrame:
    """Of folders (folder, run_ts, step, ready), the newest run of each target."""
    named = folders.withColumn("target_ts", text.target_time("run_ts", "step"))
    best = F.max_by(F.struct("folder", "run_ts", "step", "ready"), F.struct("run_ts", "folder"))
    return named.groupBy("target_ts").agg(best.alias("b")).select("target_ts", "b.*")


def usable(cache: DataFrame, now, ttl_seconds: int = 60) -> DataFrame:
    """Cached listings that need no new fetch: successes for good, failures for a minute."""
    age = F.unix_timestamp(col(now)) - F.unix_timestamp("fetched_at")
    return cache.filter((F.col("status") == "success") | (age < ttl_seconds))


# --- files -----------------------------------------------------------------------------------


def file_tasks(catalog: DataFrame, variables: list[str]) -> DataFrame:
    """One row per (variable, level) to fetch."""
    return catalog.filter(F.col("name").isin(*variables)).select("name", "level_type", "has_levels", "prefix", F.explode("levels").alias("level"))


def file_paths(tasks: DataFrame, run_ts, step, base: str, cache: str, product: str) -> DataFrame:
    """Tasks with the address of their file and where it is kept."""
    fixed = F.col("level_type") == "time-invariant"
    run, hour, step3 = text.run_text(run_ts), F.date_format(col(run_ts), "HH"), F.lpad(col(step).cast("string"), 3, "0")
    level = F.when(F.col("has_levels"), F.concat(F.lit("_"), F.col("level"))).otherwise("")
    lower = F.lower("name")
    name = F.concat(F.lit(product + "_"), "level_type", F.lit("_"), run, F.lit("_"), F.when(fixed, "000").otherwise(step3), level, F.lit("_"), F.when(fixed, "").otherwise(F.col("prefix")), lower, F.lit(".grib2.bz2"))
    url = F.concat_ws("/", F.lit(base), hour, lower, name)
    kept = F.concat_ws("/", F.lit(cache), run, F.when(fixed, "invariant").otherwise(step3), F.concat("name", level, F.lit(".grib2")))
    return tasks.withColumns({"url": url, "path": kept})


def still_to_fetch(tasks: DataFrame, present: DataFrame) -> DataFrame:
    """Tasks whose file isn't there with a size above 0."""
    return tasks.join(present.filter("size > 0").select("path"), "path", "left_anti")


# --- retention -------------------------------------------------------------------------------


def rule_of(targets: DataFrame, policy: DataFrame, today) -> DataFrame:
    """Targets (target_ts) with the first rule whose `before` exceeds their day offset; the policy is a short, configured list."""
    days = targets.withColumn("day_offset", day_offset("target_ts", today))
    rules = policy.select(F.struct("prio", "before", "hours", "mode").alias("rule")).agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    joined = days.join(F.broadcast(rules))
    return joined.withColumn("rule", F.get(F.filter("rules", lambda r: F.col("day_offset") < r["before"]), F.lit(0))).drop("rules")


def purged_by_policy(targets: DataFrame, policy: DataFrame, today) -> DataFrame:
    """Targets whose hour their rule doesn't keep. No rule, or a rule that only fetches, keeps all."""
    ruled = rule_of(targets, policy, today)
    return ruled.filter(F.col("rule").isNotNull() & (F.col("rule.mode") != "fetch_only") & ~F.array_contains("rule.hours", F.hour("target_ts")))


def purge(folders: DataFrame, policy: DataFrame, in_flight: DataFrame, today) -> DataFrame:
    """Folders (folder, run_ts, step, ready) to delete, with the reason; those in flight are left alone."""
    idle = newest_per_target(folders).join(in_flight.select("folder"), "folder", "left_anti")
    bad = idle.filter(~F.col("ready")).select("folder", F.lit("incomplete").alias("reason"))
    old = purged_by_policy(idle.filter("ready"), policy, today).select("folder", F.lit("policy").alias("reason"))
    return bad.union(old)


def fetch_window(policy: DataFrame) -> DataFrame:
    """First and last day offset that rules with a fetch mode cover; (0, 0) without such rules."""
    bound = F.lag("before", 1, OPEN_END).over(Window.orderBy("prio"))
    fetching = policy.withColumn("lower", bound).filter(F.col("mode").isin(*FETCH_MODES))
    ends = fetching.agg(F.min_by("lower", "prio").alias("lower"), (F.max_by("before", "prio") - 1).alias("upper"))
    return ends.select(F.coalesce("lower", F.lit(0)).alias("lower"), F.coalesce("upper", F.lit(0)).alias("upper"))


def target_slots(policy: DataFrame, today, earliest: int = OPEN_END) -> DataFrame:
    """All times that fetch rules ask for; `earliest` bounds an open first rule."""
    bound = F.lag("before", 1, OPEN_END).over(Window.orderBy("prio"))
    fetching = policy.withColumn("lower", F.greatest(bound, F.lit(earliest))).filter(F.col("mode").isin(*FETCH_MODES) & (F.col("lower") < F.col("before")))
    days = fetching.select("prio", "hours", F.explode(F.sequence(F.col("lower"), F.col("before") - 1)).alias("day"))
    slots = days.select("prio", "day", F.explode("hours").alias("hour"))
    at = F.date_add(col(today).cast("date"), F.col("day")).cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    return slots.select("prio", "day", "hour", at.alias("target_ts"))


# --- reconciliation and building ---------------------------------------------------------------


def reconcile(tilesets: DataFrame, disk: DataFrame) -> DataFrame:
    """Full outer join of catalogue rows and folders on disk, with the action for each."""
    d = newest_per_target(disk).select("folder", F.col("ready").alias("disk_ready"))
    both = tilesets.select("folder", "status", "step_timings").join(d, "folder", "full_outer")
    s, ready, here = F.col("status"), F.coalesce("disk_ready", F.lit(False)), F.col("disk_ready").isNotNull()
    action = (
        F.when(s.isNull() & ready, "insert_ready")
        .when(s.isNull(), "delete_folder")
        .when((s == "fetching") & ready, "set_ready")
        .when((s == "fetching") & here, "delete_folder_requeue")
        .when(s == "fetching", "requeue")
        .when((s == "pending") & ready, "set_ready")
        .when((s == "ready") & ~here, "delete_row")
        .when((s == "ready") & F.col("step_timings").isNull(), "backfill_timings")
        .otherwise("keep")
    )
    return both.select("folder", "status", "disk_ready", action.alias("action"))


def surplus(tilesets: DataFrame) -> DataFrame:
    """Rows to delete so that each target keeps its smallest step, the first inserted of equals."""
    order = Window.partitionBy("target_str").orderBy("step", "seq")
    return tilesets.withColumn("_n", F.row_number().over(order)).filter("_n > 1").drop("_n")


def last_per_target(tilesets: DataFrame) -> DataFrame:
    """The last inserted row of each target."""
    return tilesets.groupBy("target_str").agg(F.max_by(F.struct("folder", "status"), "seq").alias("r")).select("target_str", F.col("r.folder").alias("folder"), F.col("r.status").alias("status"))


def build_actions(best: DataFrame, tilesets: DataFrame, in_progress: DataFrame) -> DataFrame:
    """For each best run of a target (target_str, run_str, step): what to queue, replace or leave.

    `insert` adds beside what is there, `replace` deletes the target's row first, `ignore` meets its own
    failed row, `skip` leaves all as it is.
    """
    new = best.withColumn("new_folder", text.folder("run_str", "step")).join(in_progress.select("run_str", "step"), ["run_str", "step"], "left_anti")
    known = new.join(last_per_target(tilesets), "target_str", "left")
    s, same = F.col("status"), F.col("folder") == F.col("new_folder")
    action = (
        F.when(s.isNull(), "insert")
        .when(s == "fetching", "skip")
        .when(s.isin("ready", "pending") & same, "skip")
        .when(s.isin("pending", "failed") & ~same, "replace")
        .when(s == "failed", "ignore")
        .otherwise("insert")
    )
    return known.select("target_str", "new_folder", F.col("folder").alias("old_folder"), "status", action.alias("action"))


def stale_siblings(tilesets: DataFrame, done: DataFrame) -> DataFrame:
    """Other folders of the same target as those just done (folder)."""
    timed = lambda df: df.withColumn("target_ts", text.target_time(text.run_time("run_str"), "step"))
    fresh = timed(tilesets.join(done.select("folder"), "folder", "left_semi")).select("target_ts", F.col("folder").alias("new_folder"))
    return timed(tilesets).join(fresh, "target_ts").filter("folder <> new_folder").select("folder", "new_folder")


def leftovers(files: DataFrame, keep: tuple = ("latest.log", "invalid")) -> DataFrame:
    """Files (folder, name) of a failed set that its cleaning removes."""
    return files.filter(~F.col("name").isin(*keep))


# --- reads -------------------------------------------------------------------------------------


def by_status(tilesets: DataFrame, status: str | None = None) -> DataFrame:
    """Rows in order of insertion, of one status if one is given."""
    return (tilesets.filter(F.col("status") == status) if status else tilesets).orderBy("seq")


def count_status(tilesets: DataFrame, *statuses: str) -> DataFrame:
    return tilesets.agg(F.count_if(F.col("status").isin(*statuses)).alias("n"))


def active_by_maintenance(tilesets: DataFrame) -> DataFrame:
    return tilesets.filter(F.col("status").isin("pending", "fetching") & F.col("maintenance_id").isNotNull()).groupBy("maintenance_id").agg(F.count("*").alias("n_active"))


def failed_by_maintenance(tilesets: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Failed folders with the maintenance that queued them."""
    failed = tilesets.filter("status = 'failed'").select("maintenance_id", "folder")
    return maintenance.select(F.col("id").alias("maintenance_id"), "label").join(failed, "maintenance_id")


def ready_size(tilesets: DataFrame) -> DataFrame:
    return tilesets.agg(F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("size"))), F.lit(0)).cast("long").alias("size"))


def admitted(tilesets: DataFrame, limit: int) -> DataFrame:
    """Whether the cache has room for another set."""
    return ready_size(tilesets).select("size", (F.col("size") < limit).alias("admit"))


def next_pending(tilesets: DataFrame, n: int = 1) -> DataFrame:
    """The first pending rows in order of insertion."""
    return tilesets.filter("status = 'pending'").orderBy("seq").limit(n)


def log_since(log: DataFrame, now, seconds, default: int = 7 * 86400) -> DataFrame:
    """Log rows of the last seconds; a value that isn't a whole number means seven days."""
    span = F.coalesce(F.lit(seconds).cast("string").try_cast("long") if not isinstance(seconds, Column) else seconds.try_cast("long"), F.lit(default).cast("long"))
    return log.filter(F.unix_timestamp("dt") >= F.unix_timestamp(col(now)) - span).orderBy("id")


def incomplete(maintenance: DataFrame) -> DataFrame:
    return maintenance.filter(F.col("completed_at").isNull()).orderBy("id")


def next_time(times: DataFrame, now) -> DataFrame:
    """The next of the daily times (seconds of the day), tomorrow's first if none is left."""
    seconds = F.unix_timestamp(col(now)) - F.unix_timestamp(F.date_trunc("day", col(now)))
    later = F.min(F.when(F.col("at_seconds") > seconds, F.col("at_seconds")))
    return times.agg(F.coalesce(later, F.min("at_seconds") + 86400).alias("at_seconds"))


def listing(tilesets: DataFrame, version: int = 2) -> DataFrame:
    """What the service lists: all sets with their fields, or for version 1 the ready ones and their paths."""
    rows = tilesets if version == 2 else tilesets.filter("status = 'ready'")
    path = F.concat(F.lit("/"), "folder", F.lit("/"))
    out = rows.select(F.col("target_str").alias("id"), "folder", "run_str", "step", "status", "size", path.alias("path"))
    return (out if version == 2 else out.select("id", "path", "run_str", "step")).orderBy("id", "path")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("body"))


def servable(paths: DataFrame) -> DataFrame:
    """Paths that the service may answer, with folder, zoom, x, y; shadow maps have no tile."""
    tile = f"^{TILE_PATH}$"
    shadow = r"^(\d{10}_\d{3})/shadow_map\.ktx2$"
    good = paths.filter(F.col("path").rlike(tile) | F.col("path").rlike(shadow))
    part = lambda i: F.regexp_extract("path", tile, i).try_cast("int")
    return good.select("path", F.substring("path", 1, 14).alias("folder"), part(2).alias("zoom"), part(3).alias("x"), part(4).alias("y"))


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


# --- changes -----------------------------------------------------------------------------------


def insert_or_ignore(tilesets: DataFrame, new: DataFrame) -> DataFrame:
    """The table with those new rows whose folder it doesn't have; of equal folders the first (by seq) counts."""
    first = Window.partitionBy("folder").orderBy("seq")
    fresh = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(tilesets.select("folder"), "folder", "left_anti")
    return tilesets.unionByName(fresh, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with non-null values of `changes` in place of its own, by key."""
    new = [c for c in changes.columns if c != key]
    both = table.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def claim(tilesets: DataFrame) -> DataFrame:
    """The table with its first pending row being fetched."""
    first = next_pending(tilesets).select("folder", F.lit("fetching").alias("status"))
    return updated(tilesets, first, "folder")


def add_renewed(maintenance: DataFrame, renewed: DataFrame) -> DataFrame:
    """Maintenance rows with folders (maintenance_id, seq, folder) appended; unknown ids change nothing."""
    added = renewed.groupBy(F.col("maintenance_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "folder"))), lambda s: s["folder"]).alias("_added"))
    both = maintenance.join(added, "id", "left")
    return both.select(*[F.concat(F.coalesce("renewed", F.array().cast("array<string>")), F.coalesce("_added", F.array().cast("array<string>"))).alias("renewed") if c == "renewed" else F.col(c) for c in maintenance.columns])


def completed(maintenance: DataFrame, tilesets: DataFrame, now) -> DataFrame:
    """Open maintenance rows without active sets, closed at `now`, with the summary that the log gets."""
    idle = incomplete(maintenance).join(active_by_maintenance(tilesets).withColumnRenamed("maintenance_id", "id"), "id", "left_anti")
    failed = tilesets.filter("status = 'failed'").groupBy(F.col("maintenance_id").alias("id")).agg(F.array_sort(F.collect_list("folder")).alias("failed"))
    rows = idle.join(failed, "id", "left").withColumn("completed_at", col(now))
    minutes = F.format_string("%.1f", text.elapsed_minutes("started_at", "completed_at"))

    def line(name):
        v = F.col(name)
        return F.when(F.size(v) > 0, F.concat(F.lit(" - "), F.size(v), F.lit(f" {name} ("), text.joined(v), F.lit(")")))

    head = F.concat("label", F.lit(" Maintenance completed after "), minutes, F.lit(" min:"))
    return rows.withColumn("summary", F.concat_ws("\n", head, *[line(n) for n in ("added", "purged", "renewed", "failed")]))


def first_valid(rows: DataFrame, keys: list[str], order: str, value: str, valid, default=None) -> DataFrame:
    """Per key the value of the first row, by `order`, that is valid; the default where none is."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(valid, F.col(value)), F.when(valid, F.col(order))), F.lit(default)).alias(value))
