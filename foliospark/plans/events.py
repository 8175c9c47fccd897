"""Event log queries (a user's day is a task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import events as E
from foliospark.plans import fixtures as X
from foliospark.schemas import EVENT_STATUS

EVENTS = X.cte("e", "events", X.EVENT_COLS)
SECOND = "date_trunc('second', event_time)"
NOW = "2024-01-25 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return X.view(spark, sf, "events", X.EVENT_COLS)


def _wire(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON: numbers for even event ids, names for odd ones."""
    typed = _events(spark, sf).withColumn("data_json", F.lit(None).cast("string"))
    even = F.col("event_id") % 2 == 0
    return E.encode(typed.filter(even)).unionByName(E.encode(typed.filter(~even), False))


def event_decode(spark: SparkSession, sf: str) -> DataFrame:
    return (E.decode(_wire(spark, sf).select("event_id", "value"))
            .withColumn("event_time", F.col("event_time").cast("timestamp_ntz")))


DECODE_SQL = f"""WITH {EVENTS} SELECT event_id, task_id, status, event_type, message, filename,
{SECOND} AS event_time, CAST(NULL AS VARCHAR) AS data_json, processing_time FROM e"""


def event_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded events, compared by their fields."""
    typed = _events(spark, sf).withColumn("data_json", F.lit(None).cast("string"))
    fields = ("taskId", "status", "message", "filename", "timestamp", "eventType")
    return E.encode(typed).select(
        "event_id", F.contains("value", F.lit('"dataJson":null')).alias("null_kept"),
        F.json_tuple("value", *fields).alias(*fields))


_CODE = "CASE status " + " ".join(f"WHEN '{s}' THEN '{k}'" for k, s in enumerate(EVENT_STATUS)) + " END"
ENCODE_SQL = f"""WITH {EVENTS} SELECT event_id, task_id AS "taskId", {_CODE} AS status, message, filename,
strftime(event_time, '%Y-%m-%d %H:%M:%S') AS "timestamp",
CASE event_type WHEN 'SaveLog' THEN '1' ELSE '0' END AS "eventType", true AS null_kept FROM e"""


def task_status(spark: SparkSession, sf: str) -> DataFrame:
    return E.task_status(_events(spark, sf))


STATUS_CTE = f"""{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_time DESC, event_id DESC) AS k,
min(event_time) OVER w AS first_time, max(event_time) OVER w AS last_time, count(*) OVER w AS events
FROM e WINDOW w AS (PARTITION BY task_id)),
st AS (SELECT task_id, status, events, first_time, last_time,
status IN ('Successed', 'Failed', 'Canceled') AS finished FROM r WHERE k = 1)"""
STATUS_SQL = f"WITH {STATUS_CTE} SELECT * FROM st"


def progress_counter(spark: SparkSession, sf: str) -> DataFrame:
    counted = E.progress_counter(_events(spark, sf))
    return counted.select("event_id", "task_id", "done", "message",
                          E.parse_progress(F.col("message"))["page"].alias("page"))


DONE = "status = 'Processing' AND event_type = 'Logging' AND processing_time IS NOT NULL"
PROGRESS_SQL = f"""WITH {EVENTS}, d AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_time, event_id) AS done
FROM e WHERE {DONE}) SELECT event_id, task_id, done, concat('Done ', done, '/', total_pages, ' (Page ', page_index + 1,
') in ', printf('%.2f', processing_time), 's') AS message, page_index + 1 AS page FROM d"""


def task_timing(spark: SparkSession, sf: str) -> DataFrame:
    timing = E.task_timing(_events(spark, sf))
    return timing.select("task_id", "pages_done", F.round("page_seconds", 4).alias("page_seconds"),
                         F.round("avg_page_seconds", 4).alias("avg_page_seconds"),
                         "max_page_seconds", "duration_seconds")


TIMING_SQL = f"""WITH {EVENTS} SELECT task_id, count(*) FILTER (WHERE {DONE}) AS pages_done,
round(sum(processing_time) FILTER (WHERE {DONE}), 4) AS page_seconds,
round(avg(processing_time) FILTER (WHERE {DONE}), 4) AS avg_page_seconds,
max(processing_time) FILTER (WHERE {DONE}) AS max_page_seconds,
date_diff('second', date_trunc('second', min(event_time)), date_trunc('second', max(event_time))) AS duration_seconds
FROM e GROUP BY task_id"""


def save_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log summaries, compared by their entries."""
    logs = E.save_log(_events(spark, sf))
    entry = "array<struct<taskId:string,time:string,message:string,status:string>>"
    rows = logs.select("task_id", "entries",
                       F.posexplode(F.from_json("log_json", entry)).alias("position", "x"))
    return rows.select("task_id", "entries", "position", F.col("x.time").alias("time"),
                       F.col("x.message").alias("message"), F.col("x.status").alias("status"))


SAVE_LOG_SQL = f"""WITH {EVENTS}, t AS (SELECT DISTINCT task_id FROM e WHERE status IN ('Successed', 'Failed', 'Canceled')),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_time, event_id) AS k,
count(*) OVER (PARTITION BY task_id) AS c FROM e WHERE event_type = 'Logging' AND task_id IN (SELECT task_id FROM t))
SELECT task_id, CAST(c AS INT) AS entries, CAST(k - 1 AS INT) AS position, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS "time", message, status FROM n"""


def result_ready(spark: SparkSession, sf: str) -> DataFrame:
    return E.result_ready(_events(spark, sf)).select(
        "event_id", "task_id", "status", "event_type", "message", "data_json")


RESULT_SQL = f"""WITH {EVENTS} SELECT event_id, task_id, status, 'GetMarkdown' AS event_type, 'Markdown URL' AS message,
concat('{{"url":"get-markdown/', task_id, '"}}') AS data_json FROM e WHERE status = 'Successed' AND event_type = 'Logging'"""


def stale_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return E.stale_tasks(_events(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


STALE_SQL = f"""WITH {STATUS_CTE} SELECT task_id, status, last_time FROM st
WHERE NOT finished AND last_time < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE"""


def event_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events per model and hour (no counterpart in the service; bounds streaming state)."""
    return E.throughput(_events(spark, sf), "1 hour", "model_id").withColumn(
        "seconds", F.round("seconds", 4))


TUMBLING_SQL = f"""WITH {EVENTS} SELECT date_trunc('hour', event_time) AS window_start,
date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, model_id, count(*) AS events,
round(sum(processing_time), 4) AS seconds FROM e GROUP BY ALL"""


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Activity sessions of a user with a gap of two hours (no counterpart in the service)."""
    return E.sessions(_events(spark, sf), "user_id", 120)


SESSIONS_SQL = f"""WITH {EVENTS}, g AS (SELECT user_id, event_time, event_id, CASE WHEN event_time < lag(event_time) OVER w + INTERVAL 2 HOUR
THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_time, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, min(event_time) AS session_start, max(event_time) AS session_last, count(*) AS events
FROM s GROUP BY ALL"""

QUERIES = {
    "event_decode": (event_decode, DECODE_SQL),
    "event_encode": (event_encode, ENCODE_SQL),
    "task_status": (task_status, STATUS_SQL),
    "progress_counter": (progress_counter, PROGRESS_SQL),
    "task_timing": (task_timing, TIMING_SQL),
    "save_log": (save_log, SAVE_LOG_SQL),
    "result_ready": (result_ready, RESULT_SQL),
    "stale_tasks": (stale_tasks, STALE_SQL),
    "event_tumbling": (event_tumbling, TUMBLING_SQL),
    "event_sessions": (event_sessions, SESSIONS_SQL),
}
