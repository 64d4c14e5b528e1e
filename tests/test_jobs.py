import datetime
import os
import threading
import time

import pytest

from paperloom import schemas
from paperloom.streaming import jobs
from paperloom.streaming import webhooks as w


class Remote:
    """A service whose jobs need some polls; what it was asked is noted in files."""

    def __init__(self, folder, needed):
        self.folder, self.needed = folder, needed

    def count(self, name):
        path = f"{self.folder}/{name}"
        with open(path, "a") as f:
            f.write("x")
        return os.path.getsize(path)

    def submit(self, task_id, source):
        self.count(f"submit-{task_id}")
        if source is None:
            raise ValueError("no source")
        return f"j-{task_id}"

    def poll(self, job_id):
        n, needed = self.count(f"poll-{job_id}"), self.needed[job_id]
        if job_id == "j-c" and n == 1:
            raise OSError("unreachable")
        return ("processing", None, None) if n < needed else ("error", "bad sound", None) if job_id == "j-b" else ("completed", None, 61_000)

    def fetch(self, job_id):
        return f"text of {job_id}"


def test_jobs_are_submitted_polled_and_fetched(spark, tmp_path):
    """One completes at the third poll, one fails at the second, one is out of reach once, one never ends, one is not accepted, one comes twice."""
    needed, folder = {"j-a": 3, "j-b": 2, "j-c": 2, "j-d": 10**6}, str(tmp_path / "asked")
    os.mkdir(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.PROVIDER)
    tasks = [("a", "s"), ("b", "s"), ("c", "s"), ("d", "s"), ("e", None), ("a", "again"), (None, "s")]
    spark.createDataFrame(tasks, "task_id string, source string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("task_id string, source string").parquet(f"{tmp_path}/in")
    every, limit = datetime.timedelta(milliseconds=300), datetime.timedelta(milliseconds=2100)
    waiters = w.Waiters()
    found = jobs.job_stream(stream, lambda: Remote(folder, needed), every, limit)
    query = found.writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(w.releasing(waiters, lambda df, k: w.log_states(df, f"{tmp_path}/out", k))).start()
    got = {}
    threads = [threading.Thread(target=lambda x=x, t=t: got.update({x: waiters.wait(x, t)})) for x, t in (("a", 60), ("d", 60), ("b", 60), ("nobody", 1))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {"a": "completed", "b": "error", "d": "error", "nobody": None} and waiters.waited() == []
    rows = sorted((r.task_id, r.status, r.message, r.text, r.audio_ms) for r in spark.read.parquet(f"{tmp_path}/out").where("status <> 'processing'").collect())
    assert rows[0] == ("a", "completed", None, "text of j-a", 61_000) and rows[1] == ("b", "error", "Job j-b failed: bad sound", None, None)
    assert rows[2][:2] == ("c", "completed") and rows[3][:3] == ("d", "error", "Job j-d failed: timed out") and rows[4][:3] == ("e", "error", "no source")
    polls = {r.task_id: r.polls for r in spark.read.parquet(f"{tmp_path}/out").where("status <> 'processing'").collect()}
    assert polls["a"] == 3 and polls["b"] == 2 and polls["c"] == 2 and polls["d"] == 7 and polls["e"] == 0
    assert all(os.path.getsize(f"{folder}/submit-{x}") == 1 for x in "abcde")


def test_replay_decides_as_polls_would(spark):
    tasks = spark.createDataFrame([("a", "j1", 1000), ("b", "j2", 0), ("c", "j3", 0), ("d", None, 5), ("e", "j5", 0), ("f", "j6", 0)], "task_id string, job_id string, submitted_ms long")
    log = [("j1", 1900, "processing"), ("j1", 3050, "completed"), ("j1", 9000, "error"), ("j2", 50_000, "completed"), ("j5", 0, "error"), ("j6", 5000, "completed")]
    got = {r.task_id: (r.status, r.message, r.polls, r.decided_ms) for r in jobs.replayed_jobs(tasks, spark.createDataFrame(log, "job_id string, at_ms long, status string"), 1000, 5500).collect()}
    assert got == {"a": ("completed", None, 3, 4000), "b": ("error", "timed out", 5, 5000), "c": ("error", "timed out", 5, 5000), "d": ("error", "not submitted", 0, 5), "e": ("error", None, 1, 1000), "f": ("completed", None, 5, 5000)}


def test_waiting_ends_in_time(spark):
    waiters, start = w.Waiters(), time.perf_counter()
    assert waiters.wait("x", 0.2) is None and time.perf_counter() - start < 5
    waiters.release(spark.createDataFrame([("x", "completed")], "task_id string, status string"))
    assert waiters.wait("x", 0.1) is None  # nobody waited when it ended; the caller reads the table


T0 = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("killed", [False, True])
def test_a_replayed_batch_meters_once(spark, tmp_path, killed):
    """The second batch stops after it wrote, or is repeated; either way each task and job is metered once."""
    rows = [[("a", None, "j1", "completed", T0), ("a", None, "j1", "completed", T0)], [("a", None, "j1", "completed", T0), ("b", None, "j2", "completed", T0), ("c", None, "j9", "error", T0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schemas.WEBHOOK_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    own = spark.createDataFrame([("a", "j1"), ("b", "j2"), ("c", "j9")], "task_id string, task_job_id string")
    ledger, runs = f"{tmp_path}/ledger", []

    def handle(batch, batch_id):
        w.meter_once(w.match_webhooks(batch, own), ledger, batch_id)
        runs.append(batch_id)
        if killed and len(runs) == 2:
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(schemas.WEBHOOK_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        w.write_batches(stream, f"{tmp_path}/check", handle).awaitTermination()

    if killed:
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    w.meter_once(w.match_webhooks(spark.createDataFrame(rows[0], schemas.WEBHOOK_EVENTS), own), ledger, 0)  # and once more by hand
    assert sorted((r.task_id, r.job_id, r.units) for r in spark.read.parquet(ledger).collect()) == [("a", "j1", 1), ("b", "j2", 1)]
    assert runs == ([0, 1, 1] if killed else [0, 1])


def test_a_ledger_is_read_back_to_its_horizon(spark, tmp_path):
    one = spark.createDataFrame([("a", "j1", "ok")], "task_id string, job_id string, outcome string")
    for k in (0, 1, 5):
        w.meter_once(one, str(tmp_path), k, horizon=3)
    assert sorted(r.batch_id for r in spark.read.parquet(str(tmp_path)).collect()) == [0, 5]


def test_the_task_table_of_a_log(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    rows = [("a", "processing", at(3), "p"), ("a", "completed", at(1), "x"), ("a", "error", at(2), "late"), ("b", "init", at(0), None), ("b", "processing", at(1), "q")]
    got = w.current_tasks(spark.createDataFrame(rows, "task_id string, status string, event_ts timestamp, note string"), ["note"]).collect()
    assert sorted((r.task_id, r.status, r.note) for r in got) == [("a", "completed", "x"), ("b", "processing", "q")]
