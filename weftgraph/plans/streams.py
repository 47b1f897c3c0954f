"""Queries on event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import top_k
from weftgraph.sources.tables import load
from weftgraph.streaming import jobs as J

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_T = "('error', 'purchase')"
_UNTIL = f"""WITH f AS (SELECT user_id, min((ts, event_id)) AS e FROM events WHERE event_type IN {_T} GROUP BY user_id)
SELECT event_id, v.user_id, event_type FROM events v LEFT JOIN f ON f.user_id = v.user_id WHERE v.user_id IS NOT NULL AND (f.e IS NULL OR (v.ts, v.event_id) <= f.e)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


@query(_UNTIL)
def job_until_terminal(spark: SparkSession, d: str) -> DataFrame:
    return J.until_terminal(_events(spark, d), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query(_UNTIL)
def job_stream_state(spark: SparkSession, d: str) -> DataFrame:
    return J.stream_until_terminal(spark, d)


@query(f"WITH u AS ({_UNTIL}) SELECT user_id, count(*) AS events, CAST(count(*) FILTER (WHERE event_type IN {_T}) AS BIGINT) AS terminal FROM u GROUP BY user_id")
def job_terminal_invariant(spark: SparkSession, d: str) -> DataFrame:
    """A job that ended has exactly one terminal event."""
    u = job_until_terminal(spark, d)
    return u.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("event_type").isin(*J.TERMINAL).cast("int")).alias("terminal"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS processed FROM events WHERE user_id IS NOT NULL")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return J.progress(_events(spark, d), "user_id", "ts", "event_id").select("event_id", "user_id", "processed")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'community_view' ELSE event_type END AS event_type FROM events")
def event_retype(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "event_type")
    return e.select("event_id", F.when(F.col("event_type") == "view", "community_view").otherwise(F.col("event_type")).alias("event_type"))


@query("""SELECT 'data: {"event_id":' || event_id || ',"event_type":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events WHERE event_type IS NOT NULL""")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    return J.frames(load(spark, d, "events", "event_id", "event_type").where("event_type is not null"), "event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> 'view'")
def sse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Frames read back, among malformed ones."""
    f = J.frames(load(spark, d, "events", "event_id", "event_type").where("event_type is not null"), "event_id", "event_type")
    broken = F.when(F.contains("frame", F.lit('"view"')), F.lit("data: {broken")).otherwise(F.col("frame"))
    return J.read_frames(f.select(broken.alias("frame")), "frame", "event_id bigint, event_type string")


@query("SELECT id, length(trim(text)) AS n FROM (SELECT DISTINCT id, text FROM chunk) WHERE trim(text) <> ''")
def sse_drop_blank_sources(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk", "id", "text").distinct().where("trim(text) <> ''")
    return c.select("id", F.length(F.trim("text")).cast("bigint").alias("n"))


@query("""WITH k AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS kr FROM events WHERE user_id IS NOT NULL)
SELECT user_id, kr AS kind, count(*) AS events, min(event_id) AS first_id FROM k GROUP BY user_id, kr""")
def chat_event_order(spark: SparkSession, d: str) -> DataFrame:
    """Events of a job by the place their kind has in the prescribed order."""
    kinds = {"signup": 0, "view": 1, "click": 2, "purchase": 3}
    kr = F.lit(4)
    for k, n in kinds.items():
        kr = F.when(F.col("event_type") == k, n).otherwise(kr)
    e = load(spark, d, "events", "event_id", "user_id", "event_type").where("user_id is not null").withColumn("kind", kr)
    return e.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL) WHERE rank <= 6")
def chat_history_last6(spark: SparkSession, d: str) -> DataFrame:
    """The last six turns of each conversation; the group limit cuts before the shuffle."""
    e = _events(spark, d).where(F.col("event_type").isin("view", "click") & F.col("user_id").isNotNull())
    return top_k(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("user_id", "event_id", "rank")


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def events_hourly_extra(spark: SparkSession, d: str) -> DataFrame:
    """Beyond parity: event-time windows of an hour."""
    e = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "value")
