"""The task event log: coding, status, progress, timing, log summaries.

Functions that say so work on batch and streaming DataFrames alike. Decoded events have the
columns event_id (batch), task_id, event_time, status, event_type, message, filename, data_json,
processing_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators.running import running_sums
from foliospark.schemas import EVENT, EVENT_STATUS, EVENT_TYPE, TERMINAL_STATUS

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
ORDER = ["event_time", "event_id"]


def _enum(value: Column, names: tuple[str, ...]) -> Column:
    """Accept an enum as its number or as its name."""
    chain = F.when(value == "0", names[0])
    for number, name in enumerate(names[1:], start=1):
        chain = chain.when(value == str(number), name)
    return chain.otherwise(value)


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """Event JSON to typed columns; other columns are kept (batch and stream)."""
    keep = [c for c in raw.columns if c != value]
    return raw.select(*keep, F.from_json(value, EVENT).alias("e")).select(
        *keep, F.col("e.taskId").alias("task_id"),
        _enum(F.col("e.status"), EVENT_STATUS).alias("status"),
        _enum(F.col("e.eventType"), EVENT_TYPE).alias("event_type"),
        F.col("e.message").alias("message"), F.col("e.filename").alias("filename"),
        F.try_to_timestamp(F.col("e.timestamp"), F.lit(TIME_FORMAT)).alias("event_time"),
        F.col("e.dataJson").alias("data_json"),
        F.col("e.processingTime").alias("processing_time"))


def encode(events: DataFrame, enums_as_numbers: bool = True) -> DataFrame:
    """Typed events to (task_id, value) with camel-case keys and nulls kept (batch and stream)."""
    def code(column: str, names: tuple[str, ...]) -> Column:
        if not enums_as_numbers:
            return F.col(column)
        chain = F.when(F.col(column) == names[0], 0)
        for number, name in enumerate(names[1:], start=1):
            chain = chain.when(F.col(column) == name, number)
        return chain

    body = F.struct(
        F.col("task_id").alias("taskId"), code("status", EVENT_STATUS).alias("status"),
        F.col("message"), F.col("filename"),
        F.date_format("event_time", TIME_FORMAT).alias("timestamp"),
        code("event_type", EVENT_TYPE).alias("eventType"),
        F.col("data_json").alias("dataJson"), F.col("processing_time").alias("processingTime"))
    keep = [c for c in events.columns if c in ("event_id",)]
    return events.select(*keep, "task_id",
                         F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUS)


def is_page_done(events_status: Column, event_type: Column, processing_time: Column) -> Column:
    """A finished page: a progress log entry that carries its time."""
    return (event_type == "Logging") & (events_status == "Processing") & processing_time.isNotNull()


def task_status(events: DataFrame) -> DataFrame:
    """Latest status of each task with its first and last event time (partial aggregates only)."""
    last = F.struct("event_time", "event_id")
    return events.groupBy("task_id").agg(
        F.max_by("status", last).alias("status"), F.count("*").alias("events"),
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
    ).withColumn("finished", is_terminal(F.col("status")))


def progress_counter(events: DataFrame) -> DataFrame:
    """``Done k/N (Page p) in s.ss`` for each finished page, in completion order.

    Expects page_index and total_pages on the page events."""
    done = events.filter(is_page_done(F.col("status"), F.col("event_type"), F.col("processing_time")))
    counted = running_sums(done, ["task_id"], ORDER, {"done": F.lit(1)})
    return counted.withColumn("message", F.format_string(
        "Done %d/%d (Page %d) in %.2fs", "done", "total_pages", F.col("page_index") + 1,
        "processing_time"))


def parse_progress(message: Column) -> Column:
    """struct(done, total, page, seconds) of a progress message, null for another message."""
    pattern = r"\ADone (\d+)/(\d+) \(Page (\d+)\) in ([0-9.]+)s\z"

    def part(k: int, kind: str) -> Column:
        return F.regexp_extract(message, pattern, k).try_cast(kind)

    return F.when(message.rlike(pattern), F.struct(
        part(1, "int").alias("done"), part(2, "int").alias("total"),
        part(3, "int").alias("page"), part(4, "double").alias("seconds")))


def task_timing(events: DataFrame) -> DataFrame:
    """Pages done, processing seconds and wall-clock seconds per task."""
    done = is_page_done(F.col("status"), F.col("event_type"), F.col("processing_time"))
    seconds = F.when(done, F.col("processing_time"))
    return events.groupBy("task_id").agg(
        F.count_if(done).alias("pages_done"), F.sum(seconds).alias("page_seconds"),
        F.avg(seconds).alias("avg_page_seconds"), F.max(seconds).alias("max_page_seconds"),
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last"),
    ).withColumn("duration_seconds", F.timestamp_diff("SECOND", F.date_trunc("second", "_first"),
                                                      F.date_trunc("second", "_last"))
                 ).drop("_first", "_last")


def log_entry() -> Column:
    return F.struct(F.col("task_id").alias("taskId"),
                    F.date_format("event_time", TIME_FORMAT).alias("time"),
                    F.col("message"), F.col("status"))


def save_log(events: DataFrame, success_only: bool = False) -> DataFrame:
    """Execution log of each finished task as one JSON array, entries in order of time and id; events
    without a readable time come first."""
    ends = (F.col("status") == "Successed") if success_only else is_terminal(F.col("status"))
    entry = F.when(F.col("event_type") == "Logging", F.struct(*ORDER, log_entry().alias("entry")))
    log = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["entry"])
    return (events.groupBy("task_id").agg(log.alias("log"), F.bool_or(F.coalesce(ends, F.lit(False))).alias("_ends"))
            .filter(F.col("_ends") & (F.size("log") > 0))
            .select("task_id", F.size("log").alias("entries"),
                    F.to_json("log", {"ignoreNullFields": "false"}).alias("log_json")))


def result_ready(events: DataFrame) -> DataFrame:
    """Result notice of each success event (batch and stream)."""
    url = F.concat(F.lit("get-markdown/"), F.col("task_id"))
    ready = events.filter((F.col("status") == "Successed") & (F.col("event_type") == "Logging"))
    return (ready.withColumn("event_type", F.lit("GetMarkdown"))
            .withColumn("message", F.lit("Markdown URL"))
            .withColumn("data_json", F.to_json(F.struct(url.alias("url")))))


def stale_tasks(events: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Tasks without a terminal status that have been silent for longer than ``minutes``."""
    limit = now - F.make_interval(mins=F.lit(minutes))
    return (task_status(events).filter(~F.col("finished") & (F.col("last_time") < limit))
            .select("task_id", "status", "last_time"))


def throughput(events: DataFrame, width: str = "1 hour", *by: str) -> DataFrame:
    """Events and processing seconds per tumbling window (batch and stream)."""
    return (events.groupBy(F.window("event_time", width).alias("w"), *by)
            .agg(F.count("*").alias("events"), F.sum("processing_time").alias("seconds"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, "events", "seconds"))


def session_windows(events: DataFrame, key: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of a key: events closer together than the gap (batch, and streams with a watermark).

    Sessions that lie in one partition are merged before the exchange, so a key with a large share
    of all events sends sessions, not events. Events without a time are in no session.
    """
    # windows that touch are merged: a microsecond less keeps events a whole gap apart in two sessions
    width = f"{gap_minutes * 60 - 1} seconds 999999 microseconds"
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    return (events.groupBy(key, F.session_window("event_time", width).alias("w"))
            .agg(F.max("event_time").alias("session_last"), F.count("*").alias("events"))
            .select(key, F.col("w.start").alias("session_start"), "session_last", "events"))


def sessions(events: DataFrame, key: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of a key with their number in order of time (batch)."""
    number = F.row_number().over(W.partitionBy(key).orderBy("session_start")).cast("long")
    return session_windows(events, key, gap_minutes).select(key, number.alias("session_no"), "session_start",
                                                            "session_last", "events")
