"""Progress, state and statistics over the stream of events. A user plays a task, an event's type its stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import progress
from moraine.plans.registry import query, table
from moraine.streaming import state


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state.stream_of(spark, f"{sf_dir}/events.parquet")
    return s.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ident"), F.col("event_type").alias("value"))


@query("""SELECT user_id, max_by((props::JSON->>'k')::INTEGER, (ts, event_id)) AS last_k, max_by(event_type, (ts, event_id)) AS last_stage, count(*) AS lines, count(*) FILTER (WHERE (props::JSON->>'k') IS NULL) AS unread FROM events GROUP BY user_id""")
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress of each task, out of JSON lines."""
    lines = own(spark, sf_dir).withColumn("line", F.concat(F.lit(progress.PREFIX), "props"))
    e = lines.withColumn("k", progress.parsed(F.col("line"), "k int")["k"])
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("k", order).alias("last_k"), F.max_by("event_type", order).alias("last_stage"), F.count("*").alias("lines"), F.count_if(F.col("k").isNull()).alias("unread"))


_CHANGED = """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type"""


@query(_CHANGED)
def stage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another stage than the task's event before."""
    return progress.changed(own(spark, sf_dir), ["user_id"], "event_type", "ts", "event_id").select("event_id", "user_id", "event_type")


@query(_CHANGED)
def stream_stage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the stream, with the last stage as state."""
    return state.drained(state.changes(streamed(spark, sf_dir))).select(F.col("ident").alias("event_id"), F.col("key").alias("user_id"), F.col("value").alias("event_type"))


@query("SELECT user_id, event_type, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY user_id, event_type")
def callback_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status of a task once."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_callback_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the stream: what is sent already isn't sent again."""
    sent = state.once_within(streamed(spark, sf_dir), ["key", "value"], late="60 days")
    return state.drained(sent).select(F.col("key").alias("user_id"), F.col("value").alias("event_type"))


@query("""SELECT event_id, user_id, gap_s, CASE WHEN gap_s > 21600 THEN 'hard' WHEN gap_s > 300 THEN 'stall' END AS timeout FROM (
  SELECT event_id, user_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS gap_s FROM events) WHERE gap_s > 300""")
def stall_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps after which a task counts as stalled, or is stopped."""
    return progress.timeouts(own(spark, sf_dir), ["user_id"], "ts", "event_id").select("event_id", "user_id", "gap_s", "timeout")


@query("""WITH last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS stage, max(ts) AS seen FROM events GROUP BY user_id)
SELECT user_id, CASE stage WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, (SELECT max(ts) FROM events) - seen > INTERVAL 24 HOUR AS purged FROM last""")
def task_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each task, and whether it has been idle for a day."""
    e = own(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("seen"))
    end = F.broadcast(e.agg(F.max("ts").alias("end")))  # one row
    purged = F.col("end") - F.col("seen") > F.expr("INTERVAL 24 HOURS")
    return last.crossJoin(end).select("user_id", progress.status(F.col("stage")).alias("status"), purged.alias("purged"))


@query("""WITH last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS stage FROM events GROUP BY user_id) SELECT user_id, stage FROM last""")
def stream_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage of each task over the stream."""
    out = state.drained(state.tasks(streamed(spark, sf_dir), ttl="90 days"))
    return out.where("NOT expired").groupBy(F.col("key").alias("user_id")).agg(F.max_by("value", "at").alias("stage"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS errors, round(avg(value), 6) AS avg_latency, count(DISTINCT user_id) AS callers FROM events GROUP BY event_type")
def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, errors and mean latency by type."""
    return own(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("errors"), F.round(F.avg("value"), 6).alias("avg_latency"), F.count_distinct("user_id").alias("callers"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type over the stream."""
    s = streamed(spark, sf_dir).withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour"), "value").agg(F.count("*").alias("n"))
    out = state.drained(s.select(F.col("window.start").alias("hour"), "value", "n"), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.col("value").alias("event_type"), "n")


@query("SELECT user_id, CASE WHEN bool_and(value < 90) THEN 'healthy' WHEN bool_or(value < 90) THEN 'degraded' ELSE 'unhealthy' END AS health FROM events GROUP BY user_id")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy if all are up, degraded if some are."""
    return own(spark, sf_dir).groupBy("user_id").agg(progress.health(F.col("value") < 90).alias("health"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'error' WHEN count(*) = count(*) FILTER (WHERE event_type = 'purchase') THEN 'completed' ELSE 'pending' END AS state FROM events GROUP BY user_id""")
def indexing_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts done, any failed, or still waiting."""
    return own(spark, sf_dir).groupBy("user_id").agg(progress.confirmed(F.col("event_type") == "purchase", F.col("event_type") == "error").alias("state"))


@query("""WITH grouped AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failed FROM grouped) WHERE event_type = 'error' AND failed = 2""")
def breaker_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a circuit breaker opens: the second failure in a row."""
    return progress.opened(own(spark, sf_dir), ["user_id"], F.col("event_type") == "error", "ts", "event_id", failures=2).select("event_id", "user_id")


@query("""WITH log AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS h FROM events),
kept AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM log)
SELECT event_id, user_id, CASE WHEN h IS NULL THEN CASE WHEN known IS NOT NULL AND before IS DISTINCT FROM 'error' THEN 'delete' ELSE 'skip' END
  WHEN known IS NULL THEN 'index' WHEN h <> known THEN 'reindex' WHEN before = 'error' THEN 'restore' ELSE 'skip' END AS action FROM kept""")
def stream_change_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detection over the stream: an event's type plays the hash, errors are deletions."""
    s = streamed(spark, sf_dir).select("key", "at", "ident", F.when(F.col("value") != "error", F.col("value")).alias("hash"))
    return state.drained(state.actions(s)).select(F.col("ident").alias("event_id"), F.col("key").alias("user_id"), "action")
