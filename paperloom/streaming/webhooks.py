"""Webhooks as a stream: repeats dropped within a watermark, states kept as the latest event."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom import schemas
from paperloom.operators.tasks import match_webhooks

TERMINAL = ("completed", "error")


def read_webhooks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.WEBHOOK_EVENTS).parquet(folder)


def distinct_webhooks(webhooks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each task's and job's first webhook within the watermark; the state of older ones is dropped."""
    return webhooks.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["task_id", "job_id"])


def matched_stream(webhooks: DataFrame, tasks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct webhooks with their outcome against a table of tasks (task_id, task_job_id)."""
    return match_webhooks(distinct_webhooks(webhooks, delay), tasks)


def task_states(webhooks: DataFrame, timeout: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """task_id, status, n_events: a row whenever a task's status changes, and `timed out` for one that stays open.

    A terminal status is final: later events change nothing. State is one small row a task.
    """
    limit_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("init", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["timed out"], "n_events": [n]})
            return
        before = status
        events = pd.concat(list(batches)).sort_values(["event_ts", "status"])
        n += len(events)
        for new in events["status"]:
            if status not in TERMINAL:
                status = new
        state.update((status, n))
        if status not in TERMINAL:
            state.setTimeoutTimestamp(int(max(events["event_ts"].max().timestamp() * 1000, state.getCurrentWatermarkMs())) + limit_ms)
        if status != before:
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "n_events": [n]})

    dated = webhooks.withWatermark("event_ts", delay)
    return dated.groupBy("task_id").applyInPandasWithState(step, "task_id string, status string, n_events long", "status string, n_events long", "append", GroupStateTimeout.EventTimeTimeout)


def write_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run a stream's available data through a batch function, once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def metered(matched: DataFrame) -> DataFrame:
    return matched.where("outcome = 'ok'").select("task_id", "job_id", F.lit(1).cast("long").alias("units"))


def meter_once(matched: DataFrame, ledger: str, batch_id: int, horizon: int | None = None) -> None:
    """Add a batch's accepted webhooks to the ledger, each task and job once, whatever is replayed.

    The batch is a folder of its own that a replay replaces, and what earlier batches metered is left
    out of it: a batch that was killed half-way, or comes twice, leaves the ledger as if it had come once.
    With `horizon` only so many batches before are read, as folders: for streams whose watermark drops
    repeats of older ones, so that a batch's work does not grow with the ledger.
    """
    spark = matched.sparkSession
    schema = "task_id string, job_id string, units long, batch_id long"
    try:
        earlier = spark.read.schema(schema).parquet(ledger).where((F.col("batch_id") < batch_id) & (F.col("batch_id") >= (0 if horizon is None else batch_id - horizon)))
    except AnalysisException:  # the first batch
        earlier = spark.createDataFrame([], schema)
    fresh = metered(matched).groupBy("task_id", "job_id").agg(F.max("units").alias("units"))
    fresh.join(earlier.select("task_id", "job_id"), ["task_id", "job_id"], "left_anti").write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")


def log_states(states: DataFrame, log: str, batch_id: int) -> None:
    """A batch of task states (task_id, status, event_ts and others) as a folder of its own; a replay replaces it."""
    states.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")


def current_tasks(log: DataFrame, columns: list[str]) -> DataFrame:
    """The task table that the log stands for: of each task the first terminal state, else the latest."""
    terminal = F.col("status").isin(*TERMINAL)
    time = F.unix_micros(F.col("event_ts").cast("timestamp"))
    rank = F.struct(terminal.alias("t"), F.when(terminal, -time).otherwise(time).alias("m"), F.col("status").alias("s"))
    return log.groupBy("task_id").agg(F.max_by(F.struct("status", "event_ts", *columns), rank).alias("row")).select("task_id", "row.*")


class Waiters:
    """Callers on the driver that wait for a task's final state, released by the batches of a stream."""

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._waiting: dict[str, int] = {}
        self._final: dict[str, str] = {}

    def wait(self, task_id: str, timeout: float | None = None) -> str | None:
        """The final status, or None if it does not come in time."""
        with self._changed:
            self._waiting[task_id] = self._waiting.get(task_id, 0) + 1
            self._changed.wait_for(lambda: task_id in self._final, timeout)
            status = self._final.get(task_id)
            self._waiting[task_id] -= 1
            if not self._waiting[task_id]:
                del self._waiting[task_id]
                self._final.pop(task_id, None)
            return status

    def waited(self) -> list[str]:
        with self._changed:
            return list(self._waiting)

    def release(self, states: DataFrame) -> None:
        """Of a batch of task_id and status, only the tasks that someone waits for reach the driver."""
        wanted = self.waited()
        if not wanted:
            return
        found = states.where(F.col("task_id").isin(wanted) & F.col("status").isin(*TERMINAL)).groupBy("task_id").agg(F.min("status").alias("status")).collect()
        with self._changed:
            self._final.update({r["task_id"]: r["status"] for r in found if r["task_id"] in self._waiting})
            self._changed.notify_all()


def releasing(waiters: Waiters, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that first does its work and then releases those who wait for it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
            waiters.release(batch)
        finally:
            batch.unpersist()

    return run
