"""Files' status as a stateful stream: a machine for each path, with timers.

A log of (path, ts, event_id, kind) says when a file was found by a scan, taken up, finished or failed:

    scan    nothing or error -> pending      start  pending -> processing
    finish  processing -> done               fail   processing -> error

Any other event leaves the status as it is: a path that is pending, processing or done is not queued again. Two timers act
without an event: what has been processing for `timeout` is in error, and what has been in error for `retry` is pending again.

Events may come late and out of order. Those over the watermark wait in the state, in event time, and are applied when it has
passed them; what they amount to so far is given out at once, and again when it changes. Each row that is given out has a
version of its path's, so that the last one counts. State is a status and the waiting events of a path; nothing else is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event makes of a status; "" before the first.
STEPS = {("", "scan"): "pending", ("error", "scan"): "pending", ("pending", "start"): "processing", ("processing", "finish"): "done", ("processing", "fail"): "error"}
DELAY_MS, TIMEOUT_MS, RETRY_MS = 2 * 3_600_000, 24 * 3_600_000, 48 * 3_600_000
OUT = "path string, status string, since_ms long, attempts int, version long"


def elapsed(status: str, since: int, attempts: int, now: int, timeout: int, retry: int) -> tuple[str, int, int]:
    """What the timers have made of a status by now. since: when it began, in milliseconds."""
    if status == "processing" and since + timeout <= now:
        status, since = "error", since + timeout
    if status == "error" and since + retry <= now:
        status, since, attempts = "pending", since + retry, attempts + 1
    return status, since, attempts


def stepped(status: str, since: int, attempts: int, ms: int, kind: str, timeout: int, retry: int) -> tuple[str, int, int]:
    status, since, attempts = elapsed(status, since, attempts, ms, timeout, retry)
    to = STEPS.get((status, kind))
    return (status, since, attempts) if to is None else (to, ms, attempts + (to == "pending"))


class StatusMachine(StatefulProcessor):
    def __init__(self, timeout: int = TIMEOUT_MS, retry: int = RETRY_MS):
        self.timeout, self.retry = timeout, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, since long, attempts int, seen long, version long, told_status string, told_since long, told_attempts int")
        self.waiting = handle.getListState("waiting", "us long, event_id long, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.event_id, r.kind) for r in rows]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new, watermark: int) -> Iterator[Row]:
        held = self.settled.get() if self.settled.exists() else ("", 0, 0, -1, 0, None, None, None)
        status, since, attempts, seen, version, *told = held
        events = sorted([tuple(x) for x in self.waiting.get()] + new)
        now, left = (status, since, attempts), []
        for us, event, kind in events:
            ms = us // 1000
            now, seen = stepped(*now, ms, kind, self.timeout, self.retry), max(seen, ms)
            if ms <= watermark:
                status, since, attempts = now
            else:
                left.append((us, event, kind))
        now = elapsed(*now, max(seen, watermark), self.timeout, self.retry)
        if left:
            self.waiting.put(left)
        elif events:
            self.waiting.clear()
        # only what the watermark has passed is settled for good; timers act on that when it is next looked at
        if list(now) != told and now[0]:
            version += 1
            told = list(now)
            yield Row(path=key[0], status=now[0], since_ms=now[1], attempts=now[2], version=version)
        self.settled.update((status, since, attempts, seen, version, *told))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        waits = [now[1] + {"processing": self.timeout, "error": self.retry}[now[0]]] if now[0] in ("processing", "error") else []
        if left:
            waits.append(left[0][0] // 1000)
        if waits:
            self.handle.registerTimer(max(min(waits), watermark + 1))

    def close(self) -> None:
        pass


def statuses(log: DataFrame, delay_ms: int = DELAY_MS, timeout_ms: int = TIMEOUT_MS, retry_ms: int = RETRY_MS) -> DataFrame:
    """OUT rows of a streaming log(path, ts, event_id, kind): every change of a path's status. Rows without path or time go."""
    # a time without zone counts as UTC, whatever the session's zone
    us = F.expr("86400000000 * unix_date(cast(ts AS date)) + 3600000000 * extract(HOUR FROM ts) + 60000000L * extract(MINUTE FROM ts) + cast(1000000 * extract(SECOND FROM ts) AS long)") if dict(log.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")
    events = log.where("path IS NOT NULL AND ts IS NOT NULL").select("path", us.alias("us"), "event_id", "kind").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{delay_ms} milliseconds")
    return events.groupBy("path").transformWithState(StatusMachine(timeout_ms, retry_ms), OUT, "Append", "EventTime")


def follow(log: DataFrame, folder: str, **times) -> None:
    """Take the log to its end; changes go to folder/changes, the place in the log and the state to folder/state."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = statuses(log, **times).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").outputMode("append")
    run.trigger(availableNow=True).start().awaitTermination()


def current(changes: DataFrame) -> DataFrame:
    """path, status, since_ms, attempts: the last of each path."""
    last = Window.partitionBy("path").orderBy(F.col("version").desc())
    return changes.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("path", "status", "since_ms", "attempts")


def kind_of(event: Column) -> Column:
    """The log's kinds from the names of the events table."""
    return F.when(event.isin("signup", "click"), "scan").when(event == "view", "start").when(event == "purchase", "finish").when(event == "error", "fail")
