"""Streaming operators over decoded events (see ``foliospark.operators.events``)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.events import TIME_FORMAT, is_page_done
from foliospark.schemas import TERMINAL_STATUS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_timestamp(events: DataFrame, column: str = "event_time") -> DataFrame:
    """Watermarks need a zoned timestamp; set the session time zone to UTC before casting."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def without_duplicates(events: DataFrame, delay: str = "10 minutes",
                       key: str = "event_id") -> DataFrame:
    """Drop repeated events that arrive within the watermark delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def _ms(time) -> int:
    return int(time.value // 1_000_000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class _PerTask(StatefulProcessor):
    """State of one task, dropped ``keep`` milliseconds of event time after the task's last event.

    A task that ended keeps a mark for that long. Rows that come later still are older than the
    watermark and never get here, so what was emitted at the end is not emitted again.
    """

    fields: dict[str, str] = {}

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = {name: handle.getValueState(name, kind) for name, kind in self.fields.items()}

    def value(self, name: str):
        state = self.states[name]
        return state.get() if state.exists() else None

    def stay(self, rows: pd.DataFrame) -> None:
        """Put off the end of the state to behind the newest of some rows."""
        newest = max((_ms(t) for t in rows["event_time"] if not pd.isna(t)), default=0) + self.keep
        timers = list(self.handle.listTimers())
        if not timers or newest > max(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states.values():
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _by_task(events: DataFrame, processor: _PerTask, output: str, delay: str, *columns: str,
             mode: str = "Append") -> DataFrame:
    watched = events.withWatermark("event_time", delay).select("task_id", "event_time", *columns)
    return watched.groupBy("task_id").transformWithStateInPandas(
        processor, outputStructType=output, outputMode=mode, timeMode="EventTime")


class _Status(_PerTask):
    fields = {"newest": "ms long, event_id long, status string, events long"}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ms, at, status, events = self.value("newest") or (-1, -1, None, 0)
        for batch in rows:
            events += len(batch)
            timed = batch[batch["event_time"].notna()]
            if len(timed):
                last = timed.sort_values(["event_time", "event_id"]).iloc[-1]
                if (_ms(last["event_time"]), int(last["event_id"])) >= (ms, at):
                    ms, at, status = _ms(last["event_time"]), int(last["event_id"]), last["status"]
            self.stay(batch)
        self.states["newest"].update((ms, at, status, events))
        yield pd.DataFrame([(key[0], status, events, status in TERMINAL_STATUS)],
                           columns=["task_id", "status", "events", "finished"])


def live_status(events: DataFrame, delay: str = "10 minutes", keep_minutes: int = 60) -> DataFrame:
    """Latest status per task by time and id, a row whenever a task has news (update mode, RocksDB)."""
    return _by_task(events, _Status(keep_minutes * 60_000), "task_id string, status string, events long, finished boolean",
                    delay, "event_id", "status", mode="Update")


class _Progress(_PerTask):
    fields = {"seen": "done long, total long, ended boolean"}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, total, ended = self.value("seen") or (0, None, False)
        finished = []
        for batch in rows:
            totals = batch["total_pages"].dropna()
            total = int(totals.max()) if total is None and len(totals) else total
            pages = batch[batch["page_done"]]
            finished += zip(pages["event_time"], pages["event_id"], pages["page_index"], pages["processing_time"])
            ended = ended or bool(batch["status"].isin(TERMINAL_STATUS).any())
            self.stay(batch)
        out = []
        for _, _, page, seconds in sorted(finished, key=lambda x: (x[0], x[1])):
            if total is not None and done >= total:
                break  # all pages are told already: repeats
            done += 1
            shown = "?" if total is None else total
            out.append((key[0], done, total, f"Done {done}/{shown} (Page {int(page) + 1}) in {seconds:.2f}s"))
        self.states["seen"].update((done, total, ended))
        if out:
            frame = pd.DataFrame(out, columns=["task_id", "done", "total", "message"])
            yield frame.astype({"total": "Int64"})


def live_progress(events: DataFrame, starts: DataFrame, delay: str = "10 minutes", keep_minutes: int = 60) -> DataFrame:
    """``Done k/N (Page p) in s.ss`` for each finished page, in order of time and id within a micro-batch.

    ``starts`` is the stream of fan-outs (task_id, event_time, total_pages), united with the events
    into one state per task; a page told before its task's start shows ``?`` for N. (Append mode,
    RocksDB; the state of a task goes when it has been silent for ``keep_minutes`` of event time.)
    """
    done = is_page_done(F.col("status"), F.col("event_type"), F.col("processing_time"))
    told = events.select("task_id", "event_time", "event_id", "status", F.col("page_index").cast("int").alias("page_index"),
                         "processing_time", F.coalesce(done, F.lit(False)).alias("page_done"),
                         F.lit(None).cast("int").alias("total_pages"))
    begun = starts.select("task_id", "event_time", F.lit(-1).cast("long").alias("event_id"), F.lit("Started").alias("status"),
                          F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("double").alias("processing_time"),
                          F.lit(False).alias("page_done"), F.col("total_pages").cast("int").alias("total_pages"))
    return _by_task(told.unionByName(begun), _Progress(keep_minutes * 60_000),
                    "task_id string, done long, total long, message string", delay,
                    "event_id", "status", "page_index", "processing_time", "page_done", "total_pages")


class _Gate(_PerTask):
    fields = {"cancelled": "ms long"}

    def __init__(self, keep: int, columns: list[str]) -> None:
        super().__init__(keep)
        self.columns = columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.value("cancelled")
        limit = known[0] if known else None
        work = []
        for batch in rows:
            signals = [_ms(t) for t in batch.loc[batch["cancel_signal"], "event_time"] if not pd.isna(t)]
            if signals:
                limit = min([*signals, *([] if limit is None else [limit])])
                self.stay(batch[batch["cancel_signal"]])
            work.append(batch[~batch["cancel_signal"]])
        if limit is not None:
            self.states["cancelled"].update((limit,))
        for batch in work:
            if limit is not None:
                batch = batch[[not pd.isna(t) and _ms(t) < limit for t in batch["event_time"]]]
            if len(batch):
                yield batch[self.columns]


def live_work(work: DataFrame, cancellations: DataFrame, delay: str = "10 minutes", keep_minutes: int = 60) -> DataFrame:
    """Stream of work up to its task's cancellation; ``cancellations`` is a table or another stream.

    A table (task_id) takes out its tasks. A stream (task_id, event_time) is united with the work: a signal
    is held for ``keep_minutes`` of event time, work that is not older than its task's signal is dropped
    and never stored, and work that came before the signal has passed. (Append mode, RocksDB.)
    """
    if not cancellations.isStreaming:
        return work.join(cancellations.select("task_id"), "task_id", "left_anti")
    signals = cancellations.select("task_id", "event_time", F.lit(True).alias("cancel_signal"))
    both = work.withColumn("cancel_signal", F.lit(False)).unionByName(signals, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("task_id", "event_time")]
    return _by_task(both, _Gate(keep_minutes * 60_000, work.columns), work.schema, delay, *rest)


class _LogWriter(_PerTask):
    """Collects the log entries of a task; its first terminal event emits them as one log."""

    fields = {"ended": "at long"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states["entries"] = self.entries = handle.getListState("entries", "ms long, event_id long, entry string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = self.value("ended") is not None
        fresh, over = [], False
        for batch in rows:
            if not ended:
                logged = batch[batch["event_type"] == "Logging"]
                fresh += [(-1 if pd.isna(t) else _ms(t), int(i), json.dumps(
                    {"taskId": key[0], "time": time, "message": message, "status": status},
                    ensure_ascii=False, separators=(",", ":")))
                    for t, i, time, message, status in zip(logged["event_time"], logged["event_id"], logged["time"],
                                                           logged["message"], logged["status"])]
                over = over or bool(batch["status"].isin(TERMINAL_STATUS).any())
            self.stay(batch)
        if ended:
            return  # told once; what follows the end is no part of the log
        if not over:
            if fresh:
                self.entries.appendList(fresh)
            return
        kept = sorted([*(tuple(e) for e in self.entries.get()), *fresh] if self.entries.exists() else fresh)
        self.entries.clear()
        self.states["ended"].update((1,))
        if kept:
            yield pd.DataFrame([(key[0], len(kept), "[" + ",".join(e for _, _, e in kept) + "]")],
                               columns=["task_id", "entries", "log_json"])


def save_log_stream(events: DataFrame, delay: str = "10 minutes", keep_minutes: int = 60) -> DataFrame:
    """Log of each task at its first terminal event, once (append mode, RocksDB state store).

    Entries of the micro-batch that ends the task belong to the log, later ones do not. A task that
    never ends is forgotten after ``keep_minutes`` of event time without an event.
    """
    timed = events.withColumn("time", F.date_format("event_time", TIME_FORMAT))
    return _by_task(timed, _LogWriter(keep_minutes * 60_000), "task_id string, entries int, log_json string", delay,
                    "event_id", "event_type", "status", "message", "time")


class _StaleWatch(StatefulProcessor):
    """Emits a task whose last event is older than the limit while it is not finished."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.last.get() if self.last.exists() else None
        for batch in rows:
            timed = batch[batch["event_time"].notna()]
            if len(timed):
                row = timed.sort_values(["event_time", "event_id"]).iloc[-1]
                found = (_ms(row["event_time"]), int(row["event_id"]), row["status"])
                newest = found if newest is None or found[:2] >= tuple(newest[:2]) else newest
        if newest is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(newest)
        if newest[2] in TERMINAL_STATUS:
            self.last.clear()
        else:
            self.handle.registerTimer(newest[0] + self.limit_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            ms, _, status = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"task_id": [key[0]], "status": [status],
                                "last_time": [_time(ms)]})

    def close(self) -> None:
        pass


def stale_stream(events: DataFrame, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Tasks that have been silent for ``minutes`` of event time (append mode, RocksDB)."""
    watched = events.withWatermark("event_time", delay).select("task_id", "event_time", "event_id", "status")
    return watched.groupBy("task_id").transformWithStateInPandas(
        _StaleWatch(minutes * 60_000),
        outputStructType="task_id string, status string, last_time timestamp",
        outputMode="Append", timeMode="EventTime")
