"""Event coding, batch summaries and the streaming operators."""

import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators import events as E
from foliospark.schemas import RESPONSE
from foliospark.sources import readers, sinks
from foliospark.streaming import tasks

EVENT_COLS = ("event_id long, task_id string, event_time timestamp, status string, event_type string, "
              "message string, filename string, data_json string, processing_time double")


def log(spark):
    rows, minute = [], 0
    for task, ending in (("a", "Successed"), ("b", "Failed"), ("c", None)):
        steps = [("Started", None)] + [("Processing", 1.5)] * 3 + ([(ending, 9.0)] if ending else [])
        for status, seconds in steps:
            rows.append((len(rows), task, f"2024-01-01 00:{minute:02d}:07", status, "Logging", f"m{len(rows)}",
                         "f.pdf", None, seconds))
            minute += 2
    return spark.createDataFrame(rows, EVENT_COLS.replace("timestamp", "string")).withColumn(
        "event_time", F.to_timestamp("event_time"))


def run(query_df, mode="append"):
    name = "q" + uuid.uuid4().hex
    query = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query_df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    df = log(spark)
    for k in range(3):
        df.filter(F.floor(F.col("event_id") / 5) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return lambda: readers.event_stream(spark, str(tmp_path / "log"), df.schema, files_per_trigger=1)


def test_decode_numbers_and_names(spark):
    raw = spark.createDataFrame([
        (1, '{"taskId":"t","status":2,"eventType":1,"message":"m","timestamp":"2024-01-01 10:00:00"}'),
        (2, '{"taskId":"t","status":"Successed","eventType":"SaveLog","timestamp":"bad"}'),
        (3, "broken")], "event_id long, value string")
    got = E.decode(raw).orderBy("event_id").collect()
    assert [(r.status, r.event_type) for r in got] == [("Successed", "SaveLog")] * 2 + [(None, None)]
    assert got[0].event_time.hour == 10 and got[1].event_time is None


def test_encode_round_trip(spark):
    df = log(spark)
    for numbers in (True, False):
        coded = E.encode(df, numbers)
        body = json.loads(coded.first().value)
        assert body["status"] == (0 if numbers else "Started") and body["dataJson"] is None
        back = E.decode(coded.drop("task_id")).select(df.columns)
        assert sorted(back.collect()) == sorted(df.collect())


def test_save_log(spark):
    df = log(spark)
    whole = {r.task_id: json.loads(r.log_json) for r in E.save_log(df).collect()}
    assert set(whole) == {"a", "b"} and len(whole["a"]) == 5
    assert whole["a"][0] == {"taskId": "a", "time": "2024-01-01 00:00:07", "message": "m0", "status": "Started"}
    untimed = E.save_log(df.withColumn("event_time", F.when(F.col("event_id") % 2 == 0, F.col("event_time"))))
    assert {r.task_id: r.entries for r in untimed.collect()} == {k: len(v) for k, v in whole.items()}
    assert {r.task_id for r in E.save_log(df, success_only=True).collect()} == {"a"}


def test_stale_and_sessions(spark):
    df = log(spark)
    assert [r.task_id for r in E.stale_tasks(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()] == ["c"]
    assert E.stale_tasks(df, F.lit("2024-01-01 00:30:00").cast("timestamp")).count() == 0
    assert [r.events for r in E.sessions(df, "task_id", 2).filter("task_id = 'a'").collect()] == [1] * 5
    assert [r.events for r in E.sessions(df, "task_id", 3).filter("task_id = 'a'").collect()] == [5]


def test_progress_message(spark):
    df = log(spark).withColumn("page_index", F.lit(4)).withColumn("total_pages", F.lit(3))
    got = E.progress_counter(df).filter("task_id = 'a'").orderBy("done").collect()
    assert [r.message for r in got] == [f"Done {k}/3 (Page 5) in 1.50s" for k in (1, 2, 3)]
    back = E.progress_counter(df).select(E.parse_progress(F.col("message")).alias("p")).first().p
    assert (back.total, back.page, back.seconds) == (3, 5, 1.5)


def latest(rows):
    """The last row of each task, by the number of events it tells of."""
    return {r.task_id: r for r in sorted(rows, key=lambda r: r.events)}


def test_live_status(spark, stream):
    final = latest(run(tasks.live_status(stream()), "update").collect())
    assert {k: (r.status, r.events, r.finished) for k, r in final.items()} == {
        r.task_id: (r.status, r.events, r.finished) for r in E.task_status(log(spark)).collect()}


def test_live_progress(spark, stream, tmp_path):
    pages = lambda df: df.withColumn("page_index", F.lit(4))
    starts = spark.createDataFrame([("a", 3), ("b", 3)], "task_id string, total_pages int").withColumn(
        "event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    starts.coalesce(1).write.parquet(str(tmp_path / "starts"))
    begun = readers.event_stream(spark, str(tmp_path / "starts"), starts.schema)
    got = run(tasks.live_progress(pages(stream()), begun)).collect()
    want = E.progress_counter(pages(log(spark)).withColumn("total_pages", F.lit(3)))
    batch = {(r.task_id, r.done): r.message for r in want.collect() if r.task_id != "c"}
    assert {(r.task_id, r.done): r.message for r in got if r.task_id != "c"} == batch
    assert [r.message.split()[1] for r in got if r.task_id == "c"] == ["1/?", "2/?", "3/?"]


def test_stream_result_notice_and_cancel(spark, stream):
    assert [r.data_json for r in run(E.result_ready(stream())).collect()] == ['{"url":"get-markdown/a"}']
    gone = spark.createDataFrame([("b",)], "task_id string")
    assert {r.task_id for r in run(tasks.live_work(stream(), gone)).collect()} == {"a", "c"}


def timed(spark, rows):
    return spark.createDataFrame(rows, EVENT_COLS.replace("timestamp", "string")).withColumn(
        "event_time", F.to_timestamp("event_time"))


def files(df_list, path):
    """One file a micro-batch, in order."""
    import os
    for k, df in enumerate(df_list):
        df.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 10_000:
                os.utime(full, (1000 + k, 1000 + k))
    return path


def test_cancellation_stream(spark, stream, tmp_path):
    signals = spark.createDataFrame([("b", "2024-01-01 00:14:00"), ("c", "2024-01-01 00:00:00")], "task_id string, event_time string")
    signals.withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.parquet(str(tmp_path / "signals"))
    source = readers.event_stream(spark, str(tmp_path / "signals"), spark.read.parquet(str(tmp_path / "signals")).schema)
    passed = run(tasks.live_work(stream(), source)).collect()
    want = {r.event_id for r in log(spark).collect() if r.task_id == "a" or (r.task_id == "b" and r.event_time.minute < 14)}
    assert {r.event_id for r in passed} == want and len(passed) == len(want)


def state_rows(df, mode="append"):
    """Rows of a stream and the state rows that are left at its end."""
    name = "q" + uuid.uuid4().hex
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_log_once_and_state_ends(spark, tmp_path):
    """Several terminal events, in one batch and later, give one log; late rows give none; states go."""
    def e(i, task, time, status, message="m"):
        return (i, task, time, status, "Logging", message, "f", None, 1.0)

    batches = [
        [e(2, "a", "2024-01-01 00:02:00", "Processing"), e(1, "a", "2024-01-01 00:01:00", "Started"), e(3, "n", "2024-01-01 00:00:00", "Started")],
        [e(4, "a", "2024-01-01 00:03:00", "Failed"), e(5, "a", "2024-01-01 00:03:30", "Successed")],
        [e(6, "a", "2024-01-01 00:04:00", "Canceled"), e(7, "a", "2024-01-01 00:00:30", "Processing")],
        [e(8, "z", "2024-01-02 00:00:00", "Started")],                                   # time goes on: a and n are forgotten
        [e(9, "a", "2024-01-01 00:05:00", "Processing"), e(10, "a", "2024-01-01 00:06:00", "Failed")],  # late
        [e(11, "y", "2024-01-03 00:00:00", "Started")], [e(12, "x", "2024-01-04 00:00:00", "Started")]]
    path = files([timed(spark, rows) for rows in batches], str(tmp_path / "log"))
    source = lambda: readers.event_stream(spark, path, timed(spark, batches[0]).schema, files_per_trigger=1)
    logs, held = state_rows(tasks.save_log_stream(source(), keep_minutes=30))
    assert [(r.task_id, r.entries) for r in logs] == [("a", 4)]
    assert [x["time"][-8:] for x in json.loads(logs[0].log_json)] == ["00:01:00", "00:02:00", "00:03:00", "00:03:30"]
    _, bare = state_rows(tasks.save_log_stream(readers.event_stream(
        spark, files([timed(spark, rows) for rows in batches[5:]], str(tmp_path / "end")), timed(spark, batches[0]).schema,
        files_per_trigger=1), keep_minutes=30))
    assert held == bare  # nothing is left but what the last two events hold by themselves
    assert state_rows(tasks.live_status(source(), keep_minutes=30), "update")[1] <= held + 1


def test_stream_sessions_equal_batch(spark, tmp_path):
    df = log(spark)
    end = timed(spark, [(99, "z", "2024-01-02 00:00:00", "Started", "Logging", "m", "f", None, 1.0)])
    more = timed(spark, [(98, "y", "2024-01-03 00:00:00", "Started", "Logging", "m", "f", None, 1.0)])
    parts = [df.filter(F.floor(F.col("event_id") / 5) == k) for k in range(3)] + [end, more]
    source = readers.event_stream(spark, files(parts, str(tmp_path / "log")), df.schema, files_per_trigger=1)
    for gap in (2, 3):
        got = run(E.session_windows(source.withWatermark("event_time", "10 minutes"), "task_id", gap)).filter("task_id < 'y'")
        want = E.sessions(df, "task_id", gap).drop("session_no")
        assert sorted(got.collect()) == sorted(want.collect())


def test_stream_duplicates_and_windows(spark, stream):
    twice = stream().union(stream())
    assert run(tasks.without_duplicates(twice)).count() == 14
    windows = E.throughput(tasks.with_event_timestamp(stream()).withWatermark("event_time", "1 minute"), "10 minutes")
    assert sum(r.events for r in run(windows, "complete").collect()) == 14


def test_stream_save_log(spark, stream):
    want = {r.task_id: r.log_json for r in E.save_log(log(spark)).collect()}
    got = {r.task_id: r.log_json for r in run(tasks.save_log_stream(stream())).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: json.loads(v) for k, v in want.items()}


def test_stream_stale(spark, tmp_path):
    df = log(spark)
    later = spark.createDataFrame([(99, "z", "2024-01-01 05:00:00", "Successed", "Logging", "m", "f", None, 1.0),
                                   ], EVENT_COLS.replace("timestamp", "string")).withColumn(
        "event_time", F.to_timestamp("event_time"))
    for k, part in enumerate((df, later, later.withColumn("event_time", F.expr("event_time + interval 1 hour")))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    source = readers.event_stream(spark, str(tmp_path / "s"), df.schema, files_per_trigger=1)
    assert {r.task_id for r in run(tasks.stale_stream(source)).collect()} == {"c"}


def test_event_sink(spark, stream, tmp_path):
    coded = E.encode(stream().drop("page_index"))
    sinks.append_events(coded, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert E.decode(spark.read.parquet(str(tmp_path / "out")).drop("task_id")).count() == 14


def test_document_sinks(spark, tmp_path):
    parts = spark.createDataFrame([("t1", "a\nb\n"), ("t2", "c\n")], "task_id string, markdown string")
    sinks.write_documents(parts, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    named = sinks.with_file_name(parts.withColumn("file_stem", F.concat("task_id", F.lit("_scan"))),
                                 F.lit("2024-01-02 03:04:05").cast("timestamp"))
    sinks.export_markdown(named, str(tmp_path / "md"))
    folders = sorted(p.name for p in (tmp_path / "md").iterdir() if p.is_dir())
    assert folders == ["file_name=scan_t1_20240102_030405.md", "file_name=scan_t2_20240102_030405.md"]
    files = sorted((tmp_path / "md" / folders[0]).glob("*.txt"))
    assert "".join(f.read_text() for f in files) == "a\nb\n"
    found = [r.path for r in readers.outputs(spark, str(tmp_path / "md")).collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in found) == ["scan_t1_20240102_030405.md", "scan_t2_20240102_030405.md"]


def test_quarantine_sink_and_response_source(spark, tmp_path):
    from foliospark.operators import attempts
    rows = [("t", 0, "chandra", 1, "ab" * 600, "stop", 1, None), ("t", 1, "chandra", 1, "x", "LENGTH", 5, None),
            ("t", 2, "chandra", 1, "fine", "stop", 5, None), ("t", 3, "dots", 1, "", "stop", 5, None)]
    spark.createDataFrame(rows, RESPONSE).write.parquet(str(tmp_path / "r"))
    done = attempts.with_outcome(readers.responses(spark, str(tmp_path / "r")))
    assert [r.outcome for r in done.orderBy("page_index").collect()] == ["REPETITION", "LENGTH", "OK", "OK"]
    bad = attempts.quarantine(done)
    sinks.write_quarantine(bad, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q")).orderBy("page_index").collect()
    assert [(r.reason, r.content_length, len(r.head), len(r.tail)) for r in back] == [
        ("REPETITION", 1200, 500, 500), ("LENGTH", 1, 1, 0)]


def test_upload_and_output_sources(spark, tmp_path):
    from foliospark.operators.intake import latest_output
    for name, text in (("scan_t1_20240101_000000.md", "old"), ("scan_t1_20240102_000000.md", "newer"), ("x.pdf", "%")):
        (tmp_path / name).write_text(text)
    import os
    os.utime(tmp_path / "scan_t1_20240101_000000.md", (1, 1))
    up = readers.uploads(spark, str(tmp_path))
    assert {r.file_name: r.length for r in up.select("file_name", "length").collect()} == {
        "scan_t1_20240101_000000.md": 3, "scan_t1_20240102_000000.md": 5, "x.pdf": 1}
    newest = latest_output(readers.outputs(spark, str(tmp_path))).collect()
    assert [(r.task_id, r.path.rsplit("/")[-1]) for r in newest] == [("t1", "scan_t1_20240102_000000.md")]
    assert isinstance(up.schema["content"].dataType, T.BinaryType)
