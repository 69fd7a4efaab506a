"""Streaming queries: the given events table is read as a file stream, processed to the end, and the result table returned."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codecorpus.plans.bindings import BINDINGS
from codecorpus.plans.q_responses import PATTERN
from codecorpus.plans.registry import query
from codecorpus.sources.sinks import write_tree
from codecorpus.streaming import monitor as s
from codecorpus.streaming.rolling import rolling_lists
from codecorpus.streaming.upsert import LateSplit


def stream(t, name: str):
    """A binding over ``events`` as a stream of ranges of time in order, one to a batch, so that watermarks move and state is carried."""
    folder = f"{t.folder}/events"
    files = in_order(t.events, folder)
    source = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return bound(t, source, name)


#: Ranges of time, and rows of one file of an arriving part.
RANGES, FILE_ROWS = 8, 1_000_000


def in_order(events, folder: str, files: int | None = None) -> int:
    """Writes events range of time after range of time: a stream reads files in the order they were written. Every range has the same number of files,
    which is returned, so that a batch of so many is one range: the number of batches does not follow the input's, and no row of a range comes behind
    a watermark of its own range. A folder that is there already stays as it is."""
    timed = events.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = timed.approxQuantile("__us", [k / RANGES for k in range(1, RANGES)], 0.01)
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = timed if low is None else timed.filter(F.col("__us") >= low)
        ranges.append((part if high is None else part.filter(F.col("__us") < high)).drop("__us"))
    if files is None:
        place = sum(((F.col("__us") >= cut).cast("int") for cut in cuts), F.lit(0))
        counts = {r.p: r.n for r in timed.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each range
        files = max(1, min(counts.get(k, 0) for k in range(len(ranges))) // FILE_ROWS)
    if not has_files(events.sparkSession, folder):
        for part in ranges:
            part.repartition(files).write.mode("append").parquet(folder)
    return files


def closed(t, name: str, beat):
    """A binding as a stream of ranges of time in order, and behind them a file with ``beat``, rows that only move the watermark."""
    table, folder = getattr(t, name), f"{t.folder}/{name}"
    files = in_order(table, folder)
    beat.coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def arriving(t, rows, part, folder: str):
    """Rows as a stream whose batch k holds the k-th of the parts that ``part`` numbers; parts without rows make no batch."""
    parts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each part
    files = max(1, min(parts.values(), default=0) // FILE_ROWS)
    for k in sorted(parts):
        rows.filter(part == k).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder) if parts else None


def has_files(spark, folder: str) -> bool:
    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException:
        return False


def bound(t, source, name: str):
    view = f"cc_stream_{name}_{uuid.uuid4().hex[:8]}"
    source.createOrReplaceTempView(view)
    out = t.spark.sql(BINDINGS[name][0].replace("FROM events", f"FROM {view}"))
    t.spark.catalog.dropTempView(view)
    return out


@query("q1_stream_error_counts", "error_events", oracle=f"SELECT error_type, {PATTERN} AS pattern, count(*) AS errors FROM error_events GROUP BY 1, 2")
def _q1(t):
    out, _ = s.run_available(s.error_counts(stream(t, "error_events")), t.folder, "update", ["error_type", "pattern"])
    return out


_HEALTH = f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS ws, {PATTERN} AS pattern FROM error_events, range(0, 5) r(k)),
c AS (SELECT ws, pattern, count(*) AS n FROM w GROUP BY 1, 2)
SELECT epoch_us(ws) AS window_us, CAST(sum(n) AS BIGINT) AS recent_errors, first(pattern ORDER BY n DESC, pattern) AS most_common_pattern,
  CASE WHEN sum(n) > 3 THEN 'degraded' ELSE 'healthy' END AS status FROM c GROUP BY ws
"""


@query("q2_health", "error_events", oracle=_HEALTH)
def _q2(t):
    return s.health(t.error_events, 3).select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "recent_errors", "most_common_pattern", "status")


@query("q2_stream_health", "error_events", oracle=_HEALTH)
def _q2b(t):
    errors = t.error_events
    last = errors.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    beat = last.select(*[F.col("ts") + F.expr("INTERVAL 2 DAYS") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in errors.schema.fields]).toDF(*errors.columns)
    out, _ = s.run_available(s.health(closed(t, "error_events", beat), 3), f"{t.folder}/run")
    # The beat makes windows of its own, behind all others.
    own = out.join(F.broadcast(last), F.col("window_start") <= F.col("ts"))
    return own.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "recent_errors", "most_common_pattern", "status")


@query("q3_stream_session_errors")
def _q3(t):
    out, _ = s.run_available(s.session_errors(stream(t, "error_events")), t.folder, "update", ["session_id", "window_start"])
    return out


#: Days of errors go into this many parts of equal length.
PARTS = 8
_PART = f"CAST((epoch_us(ts) // 86400000000 - lo) * {PARTS} // (hi - lo + 1) AS BIGINT)"


@query("q3_stream_rolling_errors", "error_events", oracle=f"""
WITH d AS (SELECT min(epoch_us(ts) // 86400000000) AS lo, max(epoch_us(ts) // 86400000000) AS hi FROM error_events),
e AS (SELECT event_id, session_id, ts, dense_rank() OVER (ORDER BY {_PART}) - 1 AS k FROM error_events, d),
b AS (SELECT k AS batch_id, max(max(ts)) OVER (ORDER BY k) AS newest FROM e GROUP BY k)
SELECT batch_id, session_id, event_id, epoch_us(ts) AS us FROM b JOIN e ON e.k <= b.batch_id AND e.ts > b.newest - INTERVAL 24 HOUR""")
def _q3c(t):
    """The list of each session at the end of each of eight batches, cut at midnight."""
    errors = t.error_events
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    lo, hi = errors.agg(F.min(day), F.max(day)).first()
    part = F.floor((day - (lo or 0)) * PARTS / ((hi or 0) - (lo or 0) + 1)).cast("int")
    source = arriving(t, errors, part, f"{t.folder}/in")
    if source is None:
        return errors.select(F.lit(0).cast("bigint").alias("batch_id"), "session_id", "event_id", F.unix_micros("ts").alias("us"))
    lists, _ = rolling_lists(source, f"{t.folder}/run")
    batches = errors.select(part.alias("p")).distinct().count()
    return lists.where(F.col("batch_id") < batches).select("batch_id", "session_id", "event_id", F.unix_micros("ts").alias("us"))


@query("q3_live_session_errors", "error_events", oracle="SELECT event_id, session_id FROM error_events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def _q3b(t):
    return s.live_session_errors(t.error_events, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "session_id")


_SLOW = "SELECT event_id, 'Slow request: ' || path || ' took ' || CAST(CAST(round(CAST(CAST(processing_time AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || 's' AS message FROM requests WHERE processing_time > 10"


@query("q4_slow_requests", "requests", oracle=_SLOW)
def _q4(t):
    return s.slow_requests(t.requests).select("event_id", "message")


@query("q4_stream_slow_requests", "requests", oracle=_SLOW)
def _q4b(t):
    out, _ = s.run_available(s.slow_requests(stream(t, "requests")), t.folder)
    return out.select("event_id", "message")


@query("q4_request_counts", "requests", oracle="SELECT path, status_code, count(*) AS requests FROM requests GROUP BY 1, 2")
def _q4c(t):
    return s.request_counts(t.requests)


def _sides(log):
    return log.filter("phase = 'start'").select("operation_id", "ts", "operation_type"), log.filter("phase = 'end'").select("operation_id", "ts")


@query("q5_pair_operations", "log_events", oracle="""
WITH s AS (SELECT operation_id, ts, operation_type FROM log_events WHERE phase = 'start'), e AS (SELECT operation_id, ts FROM log_events WHERE phase = 'end')
SELECT s.operation_id, operation_type, epoch_us(s.ts) AS start_us, (epoch_us(e.ts) - epoch_us(s.ts)) / 1e6 AS duration, CASE WHEN e.ts IS NULL THEN 'open' ELSE 'completed' END AS state
FROM s LEFT JOIN e ON s.operation_id = e.operation_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 DAY""")
def _q5(t):
    return s.pair_operations(*_sides(t.log_events)).select("operation_id", "operation_type", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"), "duration", "state")


@query("q5_unknown_ends", "log_events", oracle="""
SELECT operation_id, 'Attempted to end unknown operation: ' || operation_id AS message FROM log_events e WHERE phase = 'end'
  AND NOT EXISTS (SELECT 1 FROM log_events s WHERE s.phase = 'start' AND s.operation_id = e.operation_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 DAY)""")
def _q5b(t):
    return s.unknown_ends(*_sides(t.log_events)).select("operation_id", "message")


_ALL_OPERATIONS = """
WITH s AS (SELECT operation_id, ts, operation_type FROM log_events WHERE phase = 'start'), e AS (SELECT operation_id AS end_id, ts AS end_ts FROM log_events WHERE phase = 'end')
SELECT coalesce(operation_id, end_id) AS operation_id, operation_type, epoch_us(ts) AS start_us, epoch_us(end_ts) AS end_us, (epoch_us(end_ts) - epoch_us(ts)) / 1e6 AS duration,
  CASE WHEN end_ts IS NULL THEN 'open' WHEN ts IS NULL THEN 'unknown' ELSE 'completed' END AS state
FROM s FULL JOIN e ON operation_id = end_id AND end_ts >= ts AND end_ts <= ts + INTERVAL 1 DAY"""


def _shown(operations):
    return operations.select("operation_id", "operation_type", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "duration", "state")


@query("q5_all_operations", "log_events", oracle=_ALL_OPERATIONS)
def _q5d(t):
    return _shown(s.all_operations(*_sides(t.log_events)))


@query("q5_stream_pair_operations", "log_events", oracle=_ALL_OPERATIONS)
def _q5c(t):
    """The stream sees starts and ends in time order; completed, open and unknown operations are all given out once."""
    log = closed(t, "log_events", s.beats(t.log_events))
    out, _ = s.run_available(s.all_operations(*_sides(log)), f"{t.folder}/run")
    return _shown(out)


_PROGRESS = """
SELECT session_id, count(*) AS seen_files, count(*) FILTER (status IN ('completed', 'failed')) AS finished_files, count(*) FILTER (status = 'failed') AS failed_files FROM files GROUP BY 1"""


@query("q6_stream_progress", "files", oracle=_PROGRESS)
def _q6(t):
    files = t.files.select("file_id", "session_id", "status")
    files.write.parquet(f"{t.folder}/in")
    source = t.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{t.folder}/in")
    out, _ = s.run_available(s.progress(source), f"{t.folder}/run", "update", ["session_id"])
    return out


@query("q6_progress_table", "files", oracle=_PROGRESS)
def _q6b(t):
    """The same counts in a keyed table that six batches were applied to."""
    files = t.files.select("file_id", "session_id", "status")
    source = arriving(t, files, F.pmod("file_id", F.lit(6)).cast("int"), f"{t.folder}/in")
    table = s.progress_table(t.spark, files, f"{t.folder}/table", compact_every=4)
    if source is not None:
        s.run_progress(source, table, f"{t.folder}/run")
    return table.read().drop("first_batch", "last_batch")


@query("q7_stream_corpus")
def _q7(t):
    write_tree(t.code_files, "content", "language", f"{t.folder}/in")
    out, _ = s.run_available(s.stream_corpus(t.spark, f"{t.folder}/in", 5000), f"{t.folder}/run")
    return out.select(F.regexp_extract("relative_path", "^([^/]*)", 1).alias("folder"), "language", "complexity", "overall")


@query("q8_late_events")
def _q8(t):
    """Every 50th event arrives in a third batch: what lies behind the watermark of the first is dropped and counted."""
    late, files = F.col("event_id") % 50 == 0, None
    for part, cond in enumerate((~late & (F.col("event_id") % 2 == 1), ~late & (F.col("event_id") % 2 == 0), late)):
        files = in_order(t.events.filter(cond), f"{t.folder}/in/part={part}", files)
    source = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", RANGES * files).option("recursiveFileLookup", "true").parquet(f"{t.folder}/in")
    out, late = s.run_counting_late(s.health(bound(t, source, "error_events"), 3), f"{t.folder}/run")
    return out.agg(F.count("*").alias("windows"), F.sum("recent_errors").alias("counted_errors")).withColumn("dropped_late", F.lit(late))


@query("q8_late_rows", "events", oracle="""
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 2 = 1 THEN 0 ELSE 1 END AS p FROM events),
r AS (SELECT *, dense_rank() OVER (ORDER BY p) - 1 AS k FROM e), b AS (SELECT k, max(ts) AS newest FROM r GROUP BY k)
SELECT event_id, k AS batch_id, coalesce(ts < (SELECT max(newest) FROM b WHERE b.k < r.k) - INTERVAL 10 MINUTE, FALSE) AS late FROM r""")
def _q8b(t):
    """Every event with its batch and whether it came behind the watermark; late rows are kept as rows."""
    events = t.events.select("event_id", "ts")
    part = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 2 == 1, 0).otherwise(1)
    source = arriving(t, events, part, f"{t.folder}/in")
    if source is None:
        return events.select("event_id", F.lit(0).cast("bigint").alias("batch_id"), F.lit(False).alias("late"))
    return LateSplit(source, f"{t.folder}/run").run().select("event_id", "batch_id", "late")
