"""Queries over the catalogue of tile sets, its policy, logs and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog as C
from ..schemas import JOB_VARIABLES, VARIABLES, variables
from ..sources import listings, logs, sinks, tile_table
from ..storage import scratch
from ..streaming import progress, stateful
from .base import CATALOG_SQL, DISK_SQL, ERA, NOW, POLICY_SQL, STAMP, TODAY, TILESETS_SQL, catalog, disk, policy, query, stamp, table, tilesets

K = f"WITH {CATALOG_SQL}"


def now():
    return F.lit(NOW).cast("timestamp")


# --- runs ----------------------------------------------------------------------------------------------

_LIST = "WITH l AS (SELECT strftime(TIMESTAMP '1995-06-13 00:00:00' + (p_partkey % 24) * INTERVAL 3 HOUR, '%Y%m%d%H') AS run_str, p_size % 49 AS s, p_partkey % 5 AS bad FROM part)"


@query("listed_steps", "run_str:s step:i", f"{_LIST} SELECT DISTINCT run_str, s AS step FROM l WHERE bad > 0")
def listed_steps(spark, sf):
    c = F.col("p_partkey")
    run = text.run_text(F.lit("1995-06-13 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(c % 24 * 3).cast("int")))
    step = F.lpad((F.col("p_size") % 49).cast("string"), 3, "0")
    html = F.concat(F.lit('<a href="m_model-level_'), run, F.lit("_"), F.when(c % 5 > 0, step).otherwise("x"), F.lit('_1_clc.grib2.bz2">'))
    pages = table(spark, sf, "part").select(run.alias("run_str"), html.alias("html")).groupBy("run_str").agg(F.array_join(F.collect_list("html"), "\n").alias("html"))
    return C.listed_steps(pages)


@query("listing_source", "run_str:s step:i error:b", """WITH p AS (SELECT p_partkey % 24 * 3 AS h, p_size % 49 AS s, p_partkey % 5 > 0 AS good FROM part), r AS (SELECT strftime(TIMESTAMP '1995-06-13 00:00:00' + i * INTERVAL 3 HOUR, '%Y%m%d%H') AS run_str, i * 3 % 24 AS hh, i * 3 AS h FROM range(24) t(i))
SELECT DISTINCT r.run_str, p.s AS step, false AS error FROM r JOIN p ON p.h = r.h AND good WHERE hh <> 21 AND run_str >= '1995061400' UNION ALL SELECT run_str, -1, true FROM r WHERE hh = 21 AND run_str >= '1995061400'""")
def listing_source(spark, sf):
    """Listings of every hour, written from part, and read by the data source: a partition per run, days from a filter. One hour has no listing."""
    c = F.col("p_partkey")
    run = text.run_text(F.lit("1995-06-13 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(c % 24 * 3).cast("int")))
    step = F.lpad((F.col("p_size") % 49).cast("string"), 3, "0")
    line = F.concat(F.lit('<a href="m_model-level_'), run, F.lit("_"), F.when(c % 5 > 0, step).otherwise("x"), F.lit('_1_clc.grib2.bz2">'))
    hours = table(spark, sf, "part").select(F.substring(run, 9, 2).alias("hour"), line.alias("line")).filter("hour <> '21'").distinct()
    pages = hours.groupBy("hour").agg(F.array_join(F.collect_list("line"), "\n").cast("binary").alias("content")).withColumn("path", F.concat("hour", F.lit("/clc/index.html")))
    at = scratch(spark, "listings")
    sinks.write_files(pages, at).write.format("noop").mode("overwrite").save()
    found = listings.read(spark, at + "/{hour}/clc/index.html", "1995061300", "1995061521", retries=0, once=True)
    return found.filter("run_str >= '1995061400'").select("run_str", F.coalesce("step", F.lit(-1)).alias("step"), F.col("error").isNotNull().alias("error"))


@query("latest_run", "event_id:i run:s", "SELECT event_id, strftime(date_trunc('day', s) + (hour(s) // 3 * 3) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS run FROM (SELECT event_id, ts - INTERVAL '2 hours 15 minutes' AS s FROM events)")
def latest_run(spark, sf):
    return table(spark, sf, "events").select("event_id", stamp(C.latest_run("ts")).alias("run"))


_RUNS = f"{K}, runs AS (SELECT DISTINCT run_ts FROM catalog)"


@query("relevant_runs", "run:s", f"{_RUNS} SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run FROM runs WHERE run_ts <= TIMESTAMP '{NOW}' AND date_diff('day', DATE '{TODAY}', CAST(run_ts + INTERVAL 48 HOUR AS DATE)) >= 1 AND date_diff('day', DATE '{TODAY}', CAST(run_ts AS DATE)) <= 2")
def relevant_runs(spark, sf):
    runs = catalog(spark, sf).select("run_ts").distinct()
    return C.relevant_runs(runs, now(), 1, 2).select(stamp("run_ts").alias("run"))


_AVAILABLE = f"{K}, availability AS (SELECT DISTINCT run_ts, step FROM catalog WHERE status <> 'failed'), targets AS (SELECT DISTINCT target_ts FROM catalog)"


@query("best_run", "target:s run:s step:i", f"""{_AVAILABLE} SELECT {STAMP.format('target_ts')} AS target, {STAMP.format('max(run_ts)')} AS run, min(step) AS step
FROM targets t JOIN availability a ON a.run_ts + a.step * INTERVAL 1 HOUR = t.target_ts WHERE a.run_ts <= TIMESTAMP '{NOW}' AND a.step <= 48 AND a.step % 3 = hour(t.target_ts) % 3 GROUP BY target_ts""")
def best_run(spark, sf):
    c = catalog(spark, sf)
    best = C.best_run(c.select("target_ts"), c.filter("status <> 'failed'").select("run_ts", "step").distinct(), now(), 2)
    return best.select(stamp("target_ts").alias("target"), stamp("run_ts").alias("run"), "step")


@query("available_steps", "o_orderkey:i run:s step:i", f"{_AVAILABLE}, a AS (SELECT seq AS o_orderkey, run_ts + INTERVAL 3 HOUR AS run_ts, step FROM tilesets) SELECT o_orderkey, {STAMP.format('run_ts')} AS run, step FROM a SEMI JOIN availability USING (run_ts, step)")
def available_steps(spark, sf):
    asked = tilesets(spark, sf).select(F.col("seq").alias("o_orderkey"), text.plus_hours("run_ts", F.lit(3)).alias("run_ts"), "step")
    some = catalog(spark, sf).filter("status <> 'failed'").select("run_ts", "step").distinct()
    return C.available(asked, some).select("o_orderkey", stamp("run_ts").alias("run"), "step")


_NEWEST = f"WITH {DISK_SQL}, newest AS (SELECT *, run_ts + step * INTERVAL 1 HOUR AS target_ts FROM disk QUALIFY row_number() OVER (PARTITION BY run_ts + step * INTERVAL 1 HOUR ORDER BY run_ts DESC, folder DESC) = 1)"


@query("newest_run", "target:s folder:s step:i ready:b", f"{_NEWEST} SELECT {STAMP.format('target_ts')} AS target, folder, step, ready FROM newest")
def newest_run(spark, sf):
    return C.newest_per_target(disk(spark, sf)).select(stamp("target_ts").alias("target"), "folder", "step", "ready")


@query("usable_listings", "k:i status:s", f"WITH l AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'success' END AS status, TIMESTAMP '{NOW}' - (event_id % 120) * INTERVAL 1 SECOND AS f FROM events) SELECT k, status FROM l WHERE status = 'success' OR epoch(TIMESTAMP '{NOW}') - epoch(f) < 60")
def usable_listings(spark, sf):
    k = F.col("event_id")
    cache = table(spark, sf, "events").select(k.alias("k"), F.when(k % 3 == 0, "fail").otherwise("success").alias("status"), (now() - F.make_dt_interval(secs=(k % 120).cast("decimal(8,0)"))).alias("fetched_at"))
    return C.usable(cache, now())


_V = ", ".join(f"('{n}', '{k}', {str(v is not None).lower()}, {v or [0]}, '{p}')" for n, k, v, p in VARIABLES)
_JOB = ", ".join(f"'{n}'" for n in JOB_VARIABLES)
_PATHS = f"""WITH v AS (SELECT * FROM (VALUES {_V}) v(name, level_type, has, levels, prefix)), t AS (SELECT name, level_type, has, prefix, unnest(levels) AS level FROM v WHERE name IN ({_JOB}, 'clct')),
r AS (SELECT DISTINCT strftime(TIMESTAMP '1995-06-13 00:00:00' + (p_partkey % 8) * INTERVAL 3 HOUR, '%Y%m%d%H') AS run, lpad(CAST(p_size % 5 AS VARCHAR), 3, '0') AS step FROM part)
SELECT name, level, 'https://host/grib/' || run[9:10] || '/' || name || '/model_' || level_type || '_' || run || '_' || CASE WHEN level_type = 'time-invariant' THEN '000' ELSE step END || CASE WHEN has THEN '_' || level ELSE '' END || '_' || CASE WHEN level_type = 'time-invariant' THEN '' ELSE prefix END || name || '.grib2.bz2' AS url,
'cache/' || run || '/' || CASE WHEN level_type = 'time-invariant' THEN 'invariant' ELSE step END || '/' || name || CASE WHEN has THEN '_' || level ELSE '' END || '.grib2' AS path FROM t, r"""


def _paths(spark, sf):
    c = F.col("p_partkey")
    run = F.lit("1995-06-13 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(c % 8 * 3).cast("int"))
    runs = table(spark, sf, "part").select(run.alias("run_ts"), (F.col("p_size") % 5).alias("step")).distinct()
    tasks = C.file_tasks(variables(spark), [*JOB_VARIABLES, "clct"])
    return C.file_paths(runs.join(F.broadcast(tasks)), "run_ts", "step", "https://host/grib", "cache", "model")


@query("file_tasks", "name:s level:i url:s path:s", _PATHS)
def file_tasks(spark, sf):
    return _paths(spark, sf)


@query("files_to_fetch", "n:i", f"SELECT count(*) AS n FROM ({_PATHS}) WHERE NOT (level % 3 = 0 AND level % 2 = 0)")
def files_to_fetch(spark, sf):
    tasks = _paths(spark, sf)
    present = tasks.filter("level % 3 = 0").select("path", F.when(F.col("level") % 2 == 0, 10).otherwise(0).alias("size"))
    return C.still_to_fetch(tasks, present).agg(F.count("*").alias("n"))


# --- retention ----------------------------------------------------------------------------------------

_RULED = f"""WITH {CATALOG_SQL}, {POLICY_SQL}, t AS (SELECT DISTINCT target_ts, date_diff('day', DATE '{TODAY}', CAST(target_ts AS DATE)) AS days FROM catalog),
ruled AS (SELECT t.target_ts, t.days, min_by(p.prio, p.prio) AS prio, min_by(p.mode, p.prio) AS mode, min_by(p.hours, p.prio) AS hours FROM t LEFT JOIN policy p ON t.days < p.before GROUP BY ALL)"""


@query("retention_first_match", "target:s days:i prio:i mode:s", f"{_RULED} SELECT {STAMP.format('target_ts')} AS target, days, prio, mode FROM ruled")
def retention_first_match(spark, sf):
    r = C.rule_of(catalog(spark, sf).select("target_ts").distinct(), policy(spark), F.lit(TODAY))
    return r.select(stamp("target_ts").alias("target"), F.col("day_offset").alias("days"), "rule.prio", "rule.mode")


@query("retention_purge", "target:s", f"{_RULED} SELECT {STAMP.format('target_ts')} AS target FROM ruled WHERE prio IS NOT NULL AND mode <> 'fetch_only' AND NOT list_contains(hours, hour(target_ts))")
def retention_purge(spark, sf):
    p = C.purged_by_policy(catalog(spark, sf).select("target_ts").distinct(), policy(spark), F.lit(TODAY))
    return p.select(stamp("target_ts").alias("target"))


_PURGE = f"""{_NEWEST.replace('WITH ', f'WITH {TILESETS_SQL}, {POLICY_SQL}, ', 1)}, busy AS (SELECT DISTINCT folder FROM tilesets WHERE status = 'fetching' AND size > 300000),
idle AS (SELECT * FROM newest ANTI JOIN busy USING (folder)),
r AS (SELECT i.folder, i.ready, i.target_ts, min_by(p.mode, p.prio) AS mode, min_by(p.hours, p.prio) AS hours FROM idle i LEFT JOIN policy p ON date_diff('day', DATE '{TODAY}', CAST(i.target_ts AS DATE)) < p.before GROUP BY ALL)
SELECT folder, CASE WHEN NOT ready THEN 'incomplete' ELSE 'policy' END AS reason FROM r WHERE NOT ready OR (mode IS NOT NULL AND mode <> 'fetch_only' AND NOT list_contains(hours, hour(target_ts)))"""


@query("purge", "folder:s reason:s", _PURGE)
def purge(spark, sf):
    busy = tilesets(spark, sf).filter("status = 'fetching' and size > 300000").select("folder").distinct()
    return C.purge(disk(spark, sf), policy(spark), busy, F.lit(TODAY))


@query("fetch_window", "lower:i upper:i", "SELECT -1 AS lower, 1 AS upper")
def fetch_window(spark, sf):
    return C.fetch_window(policy(spark))


@query("target_slots", "prio:i target:s", f"WITH s AS (SELECT 1 AS prio, d, h FROM range(-1, 1) a(d), (SELECT unnest([0, 6, 12, 18]) AS h) UNION ALL SELECT 2, d, h FROM range(1, 2) a(d), (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 21]) AS h)) SELECT prio, strftime(TIMESTAMP '{TODAY} 00:00:00' + d * INTERVAL 1 DAY + h * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS target FROM s")
def target_slots(spark, sf):
    return C.target_slots(policy(spark), F.lit(TODAY)).select("prio", stamp("target_ts").alias("target"))


# --- reconciliation ---------------------------------------------------------------------------------------

_RECONCILE = f"""{_NEWEST.replace('WITH ', f'WITH {CATALOG_SQL}, ', 1)} SELECT coalesce(c.folder, n.folder) AS folder, c.status, n.ready AS disk_ready,
CASE WHEN c.status IS NULL AND n.ready THEN 'insert_ready' WHEN c.status IS NULL THEN 'delete_folder' WHEN c.status = 'fetching' AND n.ready THEN 'set_ready' WHEN c.status = 'fetching' AND n.folder IS NOT NULL THEN 'delete_folder_requeue'
WHEN c.status = 'fetching' THEN 'requeue' WHEN c.status = 'pending' AND n.ready THEN 'set_ready' WHEN c.status = 'ready' AND n.folder IS NULL THEN 'delete_row' WHEN c.status = 'ready' AND NOT c.timed THEN 'backfill_timings' ELSE 'keep' END AS action
FROM catalog c FULL JOIN newest n ON c.folder = n.folder"""


@query("reconcile_actions", "folder:s status:s disk_ready:b action:s", _RECONCILE)
def reconcile_actions(spark, sf):
    return C.reconcile(catalog(spark, sf), disk(spark, sf))


@query("dedup_by_target", "seq:i folder:s", f"{K} SELECT seq, folder FROM catalog QUALIFY row_number() OVER (PARTITION BY target_str ORDER BY step, seq) > 1")
def dedup_by_target(spark, sf):
    return C.surplus(catalog(spark, sf))


_BUILD = f"""{_AVAILABLE}, best AS (SELECT t.target_ts, max(run_ts) AS run_ts, min(step) AS step FROM targets t JOIN availability a ON a.run_ts + a.step * INTERVAL 1 HOUR = t.target_ts WHERE a.run_ts <= TIMESTAMP '{NOW}' GROUP BY t.target_ts),
b AS (SELECT strftime(target_ts, '%Y%m%d%H') AS target_str, strftime(run_ts, '%Y%m%d%H') AS run_str, step, strftime(run_ts, '%Y%m%d%H') || '_' || lpad(CAST(step AS VARCHAR), 3, '0') AS new_folder FROM best),
busy AS (SELECT DISTINCT run_str, step FROM catalog WHERE seq % 11 = 0), l AS (SELECT target_str, max_by(folder, seq) AS folder, max_by(status, seq) AS status FROM catalog GROUP BY target_str)
SELECT b.target_str, new_folder, l.folder AS old_folder, l.status, CASE WHEN l.status IS NULL THEN 'insert' WHEN l.status = 'fetching' THEN 'skip' WHEN l.status IN ('ready', 'pending') AND l.folder = new_folder THEN 'skip' WHEN l.status IN ('pending', 'failed') AND l.folder <> new_folder THEN 'replace' WHEN l.status = 'failed' THEN 'ignore' ELSE 'insert' END AS action
FROM (SELECT * FROM b ANTI JOIN busy USING (run_str, step)) b LEFT JOIN l USING (target_str)"""


@query("autobuild_actions", "target_str:s new_folder:s old_folder:s status:s action:s", _BUILD)
def autobuild_actions(spark, sf):
    c = catalog(spark, sf)
    best = C.best_run(c.select("target_ts"), c.filter("status <> 'failed'").select("run_ts", "step").distinct(), now(), 2)
    named = best.select(text.run_text("target_ts").alias("target_str"), text.run_text("run_ts").alias("run_str"), "step")
    return C.build_actions(named, c, c.filter("seq % 11 = 0").select("run_str", "step").distinct())


@query("stale_siblings", "folder:s new_folder:s", f"{K}, d AS (SELECT folder AS new_folder, target_ts FROM catalog WHERE status = 'ready') SELECT c.folder, d.new_folder FROM catalog c JOIN d USING (target_ts) WHERE c.folder <> d.new_folder")
def stale_siblings(spark, sf):
    c = catalog(spark, sf).select("folder", "run_str", "step", "seq")
    return C.stale_siblings(c, c.filter("status = 'ready'").select("folder"))


@query("leftovers", "name:s n:i", "SELECT name, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'latest.log' WHEN 1 THEN 'invalid' ELSE 'tile_' || (p_partkey % 30) END AS name FROM part) WHERE name NOT IN ('latest.log', 'invalid') GROUP BY name")
def leftovers(spark, sf):
    c = F.col("p_partkey")
    files = table(spark, sf, "part").select(F.when(c % 4 == 0, "latest.log").when(c % 4 == 1, "invalid").otherwise(F.concat(F.lit("tile_"), c % 30)).alias("name"))
    return C.leftovers(files).groupBy("name").agg(F.count("*").alias("n"))


# --- reads --------------------------------------------------------------------------------------------------


@query("by_status", "seq:i folder:s", f"{K} SELECT seq, folder FROM catalog WHERE status = 'ready'")
def by_status(spark, sf):
    return C.by_status(catalog(spark, sf), "ready")


@query("active_count", "n:i", f"{K} SELECT count(*) AS n FROM catalog WHERE status IN ('pending', 'fetching')")
def active_count(spark, sf):
    return C.count_status(catalog(spark, sf), "pending", "fetching")


@query("first_valid", "target_str:s folder:s", f"WITH {TILESETS_SQL} SELECT target_str, coalesce(min_by(folder, seq) FILTER (status = 'ready' AND size % 2 = 1), 'none') AS folder FROM tilesets GROUP BY target_str")
def first_valid(spark, sf):
    """For each target the first set that is ready and of odd size, if there is one."""
    return C.first_valid(tilesets(spark, sf), ["target_str"], "seq", "folder", F.expr("status = 'ready' and size % 2 = 1"), "none")


@query("active_by_maintenance", "maintenance_id:i n_active:i", f"{K} SELECT maintenance_id, count(*) AS n_active FROM catalog WHERE status IN ('pending', 'fetching') AND maintenance_id IS NOT NULL GROUP BY ALL")
def active_by_maintenance(spark, sf):
    return C.active_by_maintenance(catalog(spark, sf))


@query("ready_size", "size:i admit:b", f"{K} SELECT coalesce(sum(size) FILTER (status = 'ready'), 0) AS size, coalesce(sum(size) FILTER (status = 'ready'), 0) < 1000000000 AS admit FROM catalog")
def ready_size(spark, sf):
    return C.admitted(catalog(spark, sf), 1_000_000_000)


@query("claim_fifo", "seq:i folder:s", f"{K} SELECT seq, folder FROM catalog WHERE status = 'pending' ORDER BY seq LIMIT 1")
def claim_fifo(spark, sf):
    return C.next_pending(catalog(spark, sf))


@query("log_since", "event_id:i", "SELECT event_id FROM events WHERE epoch(ts) >= (SELECT epoch(max(ts)) FROM events) - 7 * 86400")
def log_since(spark, sf):
    log = table(spark, sf, "events").select("event_id", F.col("event_id").alias("id"), F.col("ts").alias("dt"))
    return C.log_since(log, log.agg(F.max("dt")).scalar(), "a week")


@query("next_time", "at_seconds:i", "SELECT coalesce(min(s) FILTER (s > 49200), min(s) + 86400) AS at_seconds FROM (VALUES (7200), (28800), (50400), (72000)) v(s)")
def next_time(spark, sf):
    return C.next_time(spark.createDataFrame([(7200,), (28800,), (50400,), (72000,)], "at_seconds long"), now())


@query("listing_v1", "id:s path:s run_str:s step:i", f"{K} SELECT target_str AS id, '/' || folder || '/' AS path, run_str, step FROM catalog WHERE status = 'ready'")
def listing_v1(spark, sf):
    return C.listing(catalog(spark, sf), 1)


@query("listing_json", "body:s", f"{K} SELECT '{{\"id\":\"' || target_str || '\",\"folder\":\"' || folder || '\",\"step\":' || step || '}}' AS body FROM catalog")
def listing_json(spark, sf):
    return C.as_json(C.listing(catalog(spark, sf)).select("id", "folder", "step"))


_SERVE = "WITH p AS (SELECT CASE p_partkey % 4 WHEN 0 THEN '1995061300_003/shadow_map.ktx2' WHEN 1 THEN '../etc/' || p_partkey WHEN 2 THEN '1995061300_003/tiles/10/' || p_partkey || '/x.ktx2' ELSE '1995061300_006/tiles/9/' || p_partkey || '/' || p_size || '.ktx2' END AS path, p_partkey, p_size FROM part)"


@query("servable_paths", "path:s folder:s zoom:i x:i y:i", f"{_SERVE} SELECT path, path[1:14] AS folder, CASE WHEN p_partkey % 4 = 3 THEN 9 END AS zoom, CASE WHEN p_partkey % 4 = 3 THEN p_partkey END AS x, CASE WHEN p_partkey % 4 = 3 THEN p_size END AS y FROM p WHERE p_partkey % 4 IN (0, 3)")
def servable_paths(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, "1995061300_003/shadow_map.ktx2").when(k % 4 == 1, F.concat(F.lit("../etc/"), k)).when(k % 4 == 2, F.concat(F.lit("1995061300_003/tiles/10/"), k, F.lit("/x.ktx2"))).otherwise(F.concat(F.lit("1995061300_006/tiles/9/"), k, F.lit("/"), "p_size", F.lit(".ktx2")))
    return C.servable(table(spark, sf, "part").select(path.alias("path")))


@query("folder_sizes", "folder:s size:i", "SELECT p_brand AS folder, sum(p_size) AS size FROM part GROUP BY ALL")
def folder_sizes(spark, sf):
    return C.folder_sizes(table(spark, sf, "part").select(F.col("p_brand").alias("folder"), F.col("p_size").alias("size")))


# --- changes -------------------------------------------------------------------------------------------------


@query("insert_or_ignore", "folder:s seq:i", f"WITH {TILESETS_SQL}, old AS (SELECT folder, seq FROM tilesets WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY seq) = 1), new AS (SELECT folder, seq FROM tilesets WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY seq) = 1) SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (folder)")
def insert_or_ignore(spark, sf):
    t = tilesets(spark, sf).select("folder", "seq")
    old = t.filter("seq % 2 = 0").groupBy("folder").agg(F.min("seq").alias("seq"))
    return C.insert_or_ignore(old, t.filter("seq % 2 = 1"))


@query("set_ready", "folder:s status:s size:i", f"{K} SELECT folder, CASE WHEN seq % 4 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN seq % 4 = 0 THEN 77 ELSE size END AS size FROM catalog")
def set_ready(spark, sf):
    c = catalog(spark, sf).select("folder", "status", "size", "seq")
    return C.updated(c, c.filter("seq % 4 = 0").select("folder", F.lit("ready").alias("status"), F.lit(77).cast("long").alias("size")), "folder")


@query("claimed", "folder:s status:s", f"{K} SELECT folder, CASE WHEN seq = (SELECT min(seq) FROM catalog WHERE status = 'pending') THEN 'fetching' ELSE status END AS status FROM catalog")
def claimed(spark, sf):
    return C.claim(catalog(spark, sf).select("folder", "status", "seq"))


@query("deleted_rows", "folder:s", f"{K} SELECT folder FROM catalog WHERE seq % 3 > 0")
def deleted_rows(spark, sf):
    c = catalog(spark, sf).select("folder", "seq")
    return C.deleted(c, c.filter("seq % 3 = 0").select("folder"), "folder")


_MAINT = "maintenance AS (SELECT CAST(i AS BIGINT) AS id, 'job ' || i AS label, TIMESTAMP '1995-06-15 12:00:00' + i % 12 * INTERVAL 7 MINUTE AS started_at, CASE WHEN i % 4 = 0 THEN TIMESTAMP '1995-06-15 13:00:00' END AS completed_at, CASE WHEN i % 2 = 0 THEN ['a' || i, 'b'] ELSE [] END AS added FROM (SELECT DISTINCT o_orderkey // 1500 * 12 + j AS i FROM orders, range(12) r(j)))"


def _maintenance(spark, sf):
    """Twelve jobs for each 1,500 orders."""
    i = F.col("id")
    jobs = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / ERA).alias("era")).distinct()
    m = jobs.select(F.explode(F.sequence(F.col("era") * 12, F.col("era") * 12 + 11)).alias("id")).select(
        "id", F.concat(F.lit("job "), i).alias("label"), (F.lit("1995-06-15 12:00:00").cast("timestamp") + F.make_dt_interval(mins=(i % 12 * 7).cast("int"))).alias("started_at"),
        F.when(i % 4 == 0, F.lit("1995-06-15 13:00:00").cast("timestamp")).alias("completed_at"), F.when(i % 2 == 0, F.array(F.concat(F.lit("a"), i), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("added"),
    )
    return m.withColumns({"purged": F.array().cast("array<string>"), "renewed": F.array(F.lit("r0"))})


@query("incomplete_maintenance", "id:i label:s", f"WITH {_MAINT} SELECT id, label FROM maintenance WHERE completed_at IS NULL")
def incomplete_maintenance(spark, sf):
    return C.incomplete(_maintenance(spark, sf))


@query("failed_by_maintenance", "maintenance_id:i label:s folder:s", f"WITH {CATALOG_SQL}, {_MAINT} SELECT m.id AS maintenance_id, label, folder FROM maintenance m JOIN catalog c ON c.maintenance_id = m.id WHERE status = 'failed'")
def failed_by_maintenance(spark, sf):
    return C.failed_by_maintenance(catalog(spark, sf), _maintenance(spark, sf))


@query("add_renewed", "id:i renewed:s", f"WITH {CATALOG_SQL}, {_MAINT}, a AS (SELECT maintenance_id, string_agg(folder, ',' ORDER BY seq) AS f FROM catalog WHERE status = 'ready' GROUP BY ALL) SELECT id, 'r0' || coalesce(',' || f, '') AS renewed FROM maintenance LEFT JOIN a ON a.maintenance_id = id")
def add_renewed(spark, sf):
    r = catalog(spark, sf).filter("status = 'ready' and maintenance_id is not null").select("maintenance_id", "seq", "folder")
    return C.add_renewed(_maintenance(spark, sf), r).select("id", F.array_join("renewed", ",").alias("renewed"))


_DONE = f"""WITH {CATALOG_SQL}, {_MAINT}, active AS (SELECT DISTINCT maintenance_id AS id FROM catalog WHERE status IN ('pending', 'fetching') AND maintenance_id IS NOT NULL),
f AS (SELECT maintenance_id AS id, chr(10) || ' - ' || count(*) || ' failed (' || string_agg(folder, ', ' ORDER BY folder) || ')' AS failed FROM catalog WHERE status = 'failed' GROUP BY ALL)
SELECT id, label || ' Maintenance completed after ' || printf('%.1f', round((epoch(TIMESTAMP '{NOW}') - epoch(started_at)) / 60.0, 1)) || ' min:' || CASE WHEN len(added) > 0 THEN chr(10) || ' - ' || len(added) || ' added (' || array_to_string(added, ', ') || ')' ELSE '' END || chr(10) || ' - 1 renewed (r0)' || coalesce(f.failed, '') AS summary
FROM (SELECT * FROM maintenance ANTI JOIN active USING (id)) LEFT JOIN f USING (id) WHERE completed_at IS NULL"""


@query("completed_maintenance", "id:i summary:s", _DONE)
def completed_maintenance(spark, sf):
    return C.completed(_maintenance(spark, sf), catalog(spark, sf), now())


# --- logs and progress -----------------------------------------------------------------------------------

_LOG = "logs AS (SELECT event_id AS k, CASE WHEN event_id % 6 = 0 THEN 'nothing' ELSE 'Download completed in ' || (event_id % 90) || '.5s' || chr(10) || 'x' || chr(10) || 'Lod Generation completed in ' || (event_id % 7) || '.25s' || CASE WHEN event_id % 4 = 0 THEN chr(10) || 'Download completed in 2.00s' ELSE '' END END AS text FROM events)"


def _logs(spark, sf):
    k = F.col("event_id")
    body = F.concat(F.lit("Download completed in "), k % 90, F.lit(".5s\nx\nLod Generation completed in "), k % 7, F.lit(".25s"), F.when(k % 4 == 0, "\nDownload completed in 2.00s").otherwise(""))
    return table(spark, sf, "events").select(k.alias("k"), F.when(k % 6 == 0, "nothing").otherwise(body).alias("text"))


@query("parse_timings", "k:i download:d lod:d total:d", f"WITH {_LOG} SELECT k, CASE WHEN k % 6 > 0 THEN CASE WHEN k % 4 = 0 THEN 2.0 ELSE k % 90 + 0.5 END END AS download, CASE WHEN k % 6 > 0 THEN k % 7 + 0.25 END AS lod, CASE WHEN k % 6 > 0 THEN CASE WHEN k % 4 = 0 THEN 2.0 ELSE k % 90 + 0.5 END + k % 7 + 0.25 END AS total FROM logs")
def parse_timings(spark, sf):
    t = logs.timings(_logs(spark, sf))
    return t.select("k", F.try_element_at("timings", F.lit("download")).alias("download"), F.try_element_at("timings", F.lit("lod_generation")).alias("lod"), "total")


@query("timing_matches", "k:i n:i", f"WITH {_LOG} SELECT k, len(regexp_extract_all(text, '(\\w[\\w ]+?) completed in ([\\d.]+)s')) AS n FROM logs")
def timing_matches(spark, sf):
    return _logs(spark, sf).select("k", F.size(text.timing_pairs("text")).alias("n"))


_LINES = "lines AS (SELECT user_id AS key, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'noise' WHEN 1 THEN 'PROGRESS::lod_generation::bad' ELSE 'PROGRESS::' || CASE event_id % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'shadows' ELSE 'other' END || '::tile ' || event_id || '::' || (event_id % 101) END AS line, event_id % 5 >= 2 AS good, CASE event_id % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'shadows' ELSE 'other' END AS stage, event_id % 101 AS percent FROM events)"


def lines(spark, sf):
    k = F.col("event_id")
    stage = F.when(k % 3 == 0, "download").when(k % 3 == 1, "shadows").otherwise("other")
    body = F.concat(F.lit("PROGRESS::"), stage, F.lit("::tile "), k, F.lit("::"), k % 101)
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), k.alias("seq"), F.when(k % 5 == 0, "noise").when(k % 5 == 1, "PROGRESS::lod_generation::bad").otherwise(body).alias("line"))


@query("parse_progress", "key:i seq:i stage:s detail:s percent:d", f"WITH {_LINES} SELECT key, seq, stage, 'tile ' || seq AS detail, percent FROM lines WHERE good")
def parse_progress(spark, sf):
    return progress.parsed(lines(spark, sf))


@query("latest_progress", "key:i stage:s detail:s percent:d", f"WITH {_LINES} SELECT key, max_by(stage, seq) AS stage, 'tile ' || max(seq) AS detail, max_by(percent, seq) AS percent FROM lines WHERE good AND key % 2 = 0 GROUP BY key")
def latest_progress(spark, sf):
    known = table(spark, sf, "events").select(F.col("user_id").alias("key")).filter("key % 2 = 0").distinct()
    return progress.latest(lines(spark, sf), known)


@query("overall_percent", "seq:i overall:i", f"WITH {_LINES} SELECT seq, CASE stage WHEN 'download' THEN floor(0.3 * percent) WHEN 'shadows' THEN floor(90 + 0.1 * percent) ELSE percent END AS overall FROM lines WHERE good")
def overall_percent(spark, sf):
    return progress.parsed(lines(spark, sf)).select("seq", text.overall_percent("stage", "percent").alias("overall"))


@query("run_cadence", "run:s n:i", "SELECT strftime(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS run, count(*) AS n FROM events GROUP BY ALL")
def run_cadence(spark, sf):
    return progress.cadence(table(spark, sf, "events")).select(stamp("run_ts").alias("run"), "n")


@query("stream_progress", "key:i stage:s detail:s percent:d", f"WITH {_LINES} SELECT key, max_by(stage, seq) AS stage, 'tile ' || max(seq) AS detail, max_by(percent, seq) AS percent FROM lines WHERE good GROUP BY key")
def stream_progress(spark, sf):
    """The same reports through a stream: lines in files, the last report per key as the stream's state."""
    from ..storage import scratch

    source, state, at = (scratch(spark, name) for name in ("lines", "state", "progress"))
    lines(spark, sf).repartition(4).write.parquet(source)
    stream = progress.latest(spark.readStream.schema("key long, seq long, line string").option("maxFilesPerTrigger", 2).parquet(source))
    spark.createDataFrame([], stream.schema).write.parquet(at)
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(at)
    q = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


_QUEUE = """q AS (SELECT CAST(user_id AS VARCHAR) AS folder, event_id AS seq, CASE event_id % 7 WHEN 5 THEN 'finished' WHEN 6 THEN 'failed' WHEN 4 THEN 'failed' ELSE 'queued' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS i FROM q)"""


@query(
    "claim_stream", "folder:s seq:i attempt:i",
    f"""WITH RECURSIVE {_QUEUE}, s AS (SELECT folder, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, 'free' AS status, CAST(0 AS BIGINT) AS attempt, false AS took FROM (SELECT DISTINCT folder FROM q)
UNION ALL SELECT n.folder, n.seq, n.i, CASE WHEN s.status = 'free' AND kind = 'queued' THEN 'claimed' WHEN s.status = 'claimed' AND kind = 'finished' THEN 'ready' WHEN s.status = 'claimed' AND kind = 'failed' THEN 'free' ELSE s.status END, s.attempt + CASE WHEN s.status = 'free' AND kind = 'queued' THEN 1 ELSE 0 END, s.status = 'free' AND kind = 'queued' FROM s JOIN n ON n.folder = s.folder AND n.i = s.i + 1)
SELECT folder, seq, attempt FROM s WHERE took""",
)
def claim_stream(spark, sf):
    """Queue events through a stream in two parts, stopped between them: claims by keyed state."""
    source, state, at = (scratch(spark, name) for name in ("queue", "state", "claims"))
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 7 == 5, "finished").when(F.col("event_id") % 7 == 6, "failed").when(F.col("event_id") % 7 == 4, "failed").otherwise("queued")
    queue = e.select(F.col("user_id").cast("string").alias("folder"), F.col("event_id").alias("seq"), kind.alias("kind"))
    half = queue.agg(F.expr("(min(seq) + max(seq)) div 2").alias("half"))
    for early in (True, False):
        part = queue.join(F.broadcast(half)).filter((F.col("seq") <= F.col("half")) == early).drop("half")
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema("folder string, seq long, kind string").parquet(source)
        stateful.started(stateful.claims(stream), at, state).awaitTermination()
    return spark.read.schema("folder string, seq long, attempt long").parquet(at)


_TILES = "t AS (SELECT '19950613' || lpad(CAST(p_partkey % 3 * 6 AS VARCHAR), 2, '0') || '_003' AS folder, 9 + p_partkey % 2 AS zoom, p_size % 8 AS x, p_partkey AS row, p_name AS name FROM part)"


@query(
    "tile_lookup", "path:s content:s",
    f"WITH {_TILES}, r AS (SELECT '19950613' || lpad(CAST(o_custkey % 4 * 6 AS VARCHAR), 2, '0') || '_003/tiles/' || (9 + o_custkey % 2) || '/' || (o_orderkey % 8) || '/' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN '.png' ELSE '.ktx2' END AS path FROM orders) SELECT path, name AS content FROM r LEFT JOIN t ON path = folder || '/tiles/' || zoom || '/' || x || '/' || row || '.ktx2'",
)
def tile_lookup(spark, sf):
    """A table of tiles by folder, zoom and x, part of it written again, and what each requested path finds."""
    at = scratch(spark, "tiles")
    k, hour = F.col("p_partkey"), lambda c: F.lpad((c * 6).cast("string"), 2, "0")
    tiles = table(spark, sf, "part").select(F.concat(F.lit("19950613"), hour(k % 3), F.lit("_003")).alias("folder"), (9 + k % 2).alias("zoom"), (F.col("p_size") % 8).alias("x"), k.alias("row"), F.col("p_name").cast("binary").alias("content"))
    tile_table.save(tiles.withColumn("content", F.when(F.col("x") < 4, F.lit(b"old")).otherwise(F.col("content"))), at)
    tile_table.save(tiles.filter("x < 4"), at)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("19950613"), hour(c % 4), F.lit("_003/tiles/"), 9 + c % 2, F.lit("/"), o % 8, F.lit("/"), c, F.when(o % 5 == 0, ".png").otherwise(".ktx2"))
    return tile_table.many(table(spark, sf, "orders").select(path.alias("path")), at).select("path", F.col("content").cast("string").alias("content"))
