"""The life of remote jobs as a stream: submit, poll by timer, fetch, time out; and the same from a log, as a batch.

A service is a factory, called once per task of the stream, of an object with
`submit(task_id, source) -> job_id`, `poll(job_id) -> (status, message, audio_ms)` and `fetch(job_id) -> text`.
The task id is the correlation id: after a failure Spark may repeat a call, and a service tells repeats by it.

State is one small row a task, which expires `keep` after its last change; a task that comes again while its
state is there is not submitted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "task_id string, job_id string, status string, message string, text string, audio_ms long, polls int"
_STATE = "job_id string, submitted_ms long, polls int, status string"
DONE = ("completed", "error")
TIMED_OUT = "timed out"


class Service(Protocol):
    def submit(self, task_id: str, source: str) -> str: ...

    def poll(self, job_id: str) -> tuple[str, str | None, int | None]: ...

    def fetch(self, job_id: str) -> str | None: ...


class JobLife(StatefulProcessor):
    def __init__(self, service: Callable[[], Service], every: timedelta, limit: timedelta, keep: timedelta) -> None:
        self.make, self.every_ms, self.limit_ms, self.keep_ms = service, int(every.total_seconds() * 1000), int(limit.total_seconds() * 1000), int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.service = handle, self.make()
        # an open job is touched at each poll, so it cannot expire before its limit
        self.state = handle.getValueState("job", _STATE, ttlDurationMs=max(self.keep_ms, 2 * self.every_ms))

    def _row(self, task_id: str, job_id: str | None, status: str, polls: int, message: str | None = None, text: str | None = None, audio_ms: int | None = None) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [task_id], "job_id": [job_id], "status": [status], "message": [message], "text": [text], "audio_ms": pd.array([audio_ms], "Int64"), "polls": pd.array([polls], "int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        source = pd.concat(list(rows))["source"].dropna().min()
        if self.state.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        try:
            job_id = self.service.submit(key[0], None if pd.isna(source) else source)
        except Exception as e:
            self.state.update(("", now, 0, "error"))
            yield self._row(key[0], None, "error", 0, str(e) or type(e).__name__)
            return
        self.state.update((job_id, now, 0, "processing"))
        self.handle.registerTimer(now + self.every_ms)
        yield self._row(key[0], job_id, "processing", 0)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        job_id, submitted, polls, status = self.state.get()
        if status in DONE:
            return
        now, polls = timerValues.getCurrentProcessingTimeInMs(), polls + 1
        message, audio_ms, text = None, None, None
        try:
            status, message, audio_ms = self.service.poll(job_id)
            if status == "completed":
                text = self.service.fetch(job_id)
        except Exception as e:  # no answer; the next poll may have one
            status, message = "processing", str(e) or type(e).__name__
        if status not in DONE and polls >= self.limit_ms // self.every_ms:
            status, message = "error", TIMED_OUT
        if status in DONE:
            self.state.update((job_id, submitted, polls, status))
            yield self._row(key[0], job_id, status, polls, f"Job {job_id} failed: {message}" if status == "error" else None, text, audio_ms)
        else:
            self.state.update((job_id, submitted, polls, "processing"))
            self.handle.registerTimer(max(now, expiredTimerInfo.getExpiryTimeInMs()) + self.every_ms)

    def close(self) -> None:
        pass


def job_stream(tasks: DataFrame, service: Callable[[], Service], every: timedelta = timedelta(seconds=5), limit: timedelta = timedelta(hours=2), keep: timedelta = timedelta(days=1)) -> DataFrame:
    """OUTPUT rows as jobs go on: processing when submitted, then completed with its text, or error with why.

    tasks: a stream of task_id and source. Needs the RocksDB state store (PROVIDER). A job is polled
    limit / every times at most: where batches take longer than `every`, later in time but as often.
    """
    rows = tasks.select(F.col("task_id").cast("string").alias("task_id"), F.col("source").cast("string").alias("source")).where("task_id IS NOT NULL")
    return rows.groupBy("task_id").transformWithStateInPandas(JobLife(service, every, limit, keep), OUTPUT, "append", "processingTime")


def replayed_jobs(tasks: DataFrame, statuses: DataFrame, every_ms: int, limit_ms: int) -> DataFrame:
    """task_id, job_id, status, message, polls, decided_ms: what `job_stream` decides, from a log of the service, as joins and one grouping.

    tasks: task_id, job_id (null where the submission failed), submitted_ms. statuses: job_id, at_ms, status. A job's first
    terminal status is final; polls come every every_ms after the submission, while they are within limit_ms.
    """
    terminal = statuses.where(F.col("status").isin(*DONE)).groupBy("job_id").agg(F.min(F.struct("at_ms", "status")).alias("end"))
    rows = tasks.join(terminal, "job_id", "left")
    last = limit_ms // every_ms
    due = F.greatest(F.lit(1), F.ceil((F.col("end.at_ms") - F.col("submitted_ms")) / every_ms)).cast("long")
    seen = F.col("end").isNotNull() & (due <= last)
    polls = F.when(F.col("job_id").isNull(), F.lit(0)).when(seen, due).otherwise(F.lit(last)).cast("long")
    status = F.when(seen & F.col("job_id").isNotNull(), F.col("end.status")).otherwise(F.lit("error"))
    message: Column = F.when(F.col("job_id").isNull(), F.lit("not submitted")).when(~seen, F.lit(TIMED_OUT))
    return rows.select("task_id", "job_id", status.alias("status"), message.alias("message"), polls.alias("polls"), (F.col("submitted_ms") + polls * every_ms).alias("decided_ms"))
