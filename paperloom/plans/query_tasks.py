"""Queries on task states, webhooks and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.catalog import query, table
from paperloom.operators import tasks
from paperloom.streaming import jobs
from paperloom.streaming import webhooks as webhook_states

STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'error' END"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "init").when(kind.isin("view", "click"), "processing").when(kind == "purchase", "completed").otherwise("error")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", status.alias("task_status"), F.when(kind == "purchase", F.col("props")).alias("result"))


LATEST_SQL = f"SELECT user_id, ts, event_id, {STATUS_SQL} AS task_status, CASE WHEN event_type = 'purchase' THEN props END AS result FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(LATEST_SQL)
def task_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.final_states(states(spark, sf_dir), "user_id", "ts", "event_id", ["task_status", "result"])


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a listing; the limit is the feature."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tasks.task_page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], offset=20, limit=10)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def task_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 77)


@query(f"SELECT user_id, CASE WHEN task_status <> 'completed' THEN 'Task is not completed yet' ELSE coalesce(result, '') END AS body FROM ({LATEST_SQL})")
def result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = tasks.final_states(states(spark, sf_dir), "user_id", "ts", "event_id", ["task_status", "result"])
    return latest.select("user_id", tasks.result_view(F.col("task_status"), F.col("result")).alias("body"))


@query("SELECT event_id, s AS status, s IN ('done', 'rejected') AS finished FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'rejected' WHEN 2 THEN 'running' ELSE 'expired' END AS s FROM events)")
def job_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.lit(["done", "rejected", "running", "expired"]), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).withColumn("finished", tasks.is_terminal(F.col("status")))


WEBHOOK_SQL = "SELECT event_id, ts, user_id AS task_id, CASE WHEN event_id % 5 <> 0 THEN 'job-' || cast(user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS job_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'completed' END AS route_status FROM events"
OWN_SQL = "SELECT DISTINCT user_id AS task_id, CASE WHEN user_id % 10 <> 4 THEN 'job-' || cast(user_id AS VARCHAR) END AS task_job_id FROM events"


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    job = F.when(n % 5 != 0, F.concat(F.lit("job-"), (user + F.when(n % 7 == 0, 1).otherwise(0)).cast("string")))
    return table(spark, sf_dir, "events").select(n, "ts", user.alias("task_id"), job.alias("job_id"), F.when(kind == "error", "error").when(kind == "view", "processing").otherwise("completed").alias("status"), F.when(n % 11 == 0, "error").otherwise("completed").alias("route_status"))


def own_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct()
    return users.withColumn("task_job_id", F.when(F.col("task_id") % 10 != 4, F.concat(F.lit("job-"), F.col("task_id").cast("string"))))


@query(f"""
SELECT event_id, w.task_id, CASE WHEN task_job_id IS NULL THEN 'Transcription job ID is required' WHEN route_status = 'error' THEN '' WHEN job_id IS NULL OR task_job_id <> job_id THEN 'Transcription job ID does not match'
  WHEN status <> 'completed' THEN 'Transcription job status is error' ELSE 'ok' END AS outcome FROM ({WEBHOOK_SQL}) w LEFT JOIN ({OWN_SQL}) t ON t.task_id = w.task_id
""")
def webhook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.match_webhooks(webhooks(spark, sf_dir), own_jobs(spark, sf_dir)).select("event_id", "task_id", "outcome")


@query(f"SELECT task_id, job_id, ts, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY task_id, job_id ORDER BY ts, event_id) AS r FROM ({WEBHOOK_SQL})) WHERE r = 1")
def webhook_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.first_webhooks(webhooks(spark, sf_dir), "ts", "event_id", ["status"])


@query("SELECT event_id, coalesce(u, user_id % 7) AS owner, coalesce(u, user_id % 7) = user_id % 7 OR event_type = 'signup' AS allowed FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN user_id % 5 END AS u FROM events)")
def ownership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, caller = F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 5), F.col("user_id") % 7
    who, allowed = tasks.owner(user, caller, F.col("event_type") == "signup")
    return table(spark, sf_dir, "events").select("event_id", who.alias("owner"), allowed.alias("allowed"))


JOBS_SQL = """
SELECT task_id, CASE WHEN task_id % 9 <> 2 THEN 'job-' || cast(task_id AS VARCHAR) END AS job_id, submitted_ms FROM (SELECT user_id AS task_id, min(epoch_us(ts)) // 1000 AS submitted_ms FROM events GROUP BY user_id)
"""


@query(f"""
SELECT task_id, job_id, CASE WHEN job_id IS NULL OR due IS NULL OR due > 480 THEN 'error' ELSE status END AS status, CASE WHEN job_id IS NULL THEN 'not submitted' WHEN due IS NULL OR due > 480 THEN 'timed out' END AS message,
  CASE WHEN job_id IS NULL THEN 0 WHEN due <= 480 THEN due ELSE 480 END AS polls, submitted_ms + CASE WHEN job_id IS NULL THEN 0 WHEN due <= 480 THEN due ELSE 480 END * 3600000 AS decided_ms
FROM (SELECT task_id, job_id, submitted_ms, status, greatest(1, cast(ceil((at_ms - submitted_ms) / 3600000) AS BIGINT)) AS due FROM ({JOBS_SQL}) t LEFT JOIN
  (SELECT 'job-' || cast(user_id AS VARCHAR) AS job_id, min(epoch_us(ts) // 1000) AS at_ms, arg_min(s, (epoch_us(ts), s)) AS status FROM (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'error' END AS s FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY user_id) e USING (job_id))
""")
def job_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the log of a remote job: an hour between polls, twenty days at most, some never submitted."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type")
    job = F.concat(F.lit("job-"), F.col("user_id").cast("string"))
    started = events.groupBy("user_id").agg(F.min("at_ms").alias("submitted_ms")).select(F.col("user_id").alias("task_id"), F.when(F.col("user_id") % 9 != 2, job).alias("job_id"), "submitted_ms")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("processing")
    return jobs.replayed_jobs(started, events.select(job.alias("job_id"), "at_ms", status.alias("status")), 3_600_000, 20 * 86_400_000)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def task_page_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of one user's listing."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    user = rows.agg(F.min("o_custkey")).first()[0]
    return tasks.task_page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], user=user, user_col="o_custkey").select("o_orderkey", "o_orderdate")


DOCUMENT_SQL = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'https://host.example/' || cast(event_id AS VARCHAR) END AS file_url, CASE WHEN event_id % 4 = 1 THEN event_type END AS note, user_id FROM events"


def created_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n, F.when(n % 3 != 0, F.concat(F.lit("https://host.example/"), n.cast("string"))).alias("file_url"), F.when(n % 4 == 1, F.col("event_type")).alias("note"), "user_id")


@query(f"""
SELECT event_id, '{{"event_id":' || cast(event_id AS VARCHAR) || coalesce(',"file_url":"' || file_url || '"', '') || coalesce(',"note":"' || note || '"', '') || ',"user_id":' || cast(user_id AS VARCHAR) || ',"tenant_id":"t1","task_status":"init"}}' AS document FROM ({DOCUMENT_SQL})
""")
def insert_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created tasks as they are inserted, without the fields that are null."""
    return tasks.insert_document(created_tasks(spark, sf_dir), "event_id", tenant_id=F.lit("t1"))


@query(f"""
SELECT event_id, '{{"event_id":' || cast(event_id AS VARCHAR) || ',"file_url":' || coalesce('"' || file_url || '"', 'null') || ',"user_id":' || cast(user_id AS VARCHAR) || '}}' AS payload FROM ({DOCUMENT_SQL})
""")
def webhook_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What webhooks of tasks send, all fields but an excluded one."""
    return tasks.webhook_payload(created_tasks(spark, sf_dir), "event_id", ("note", "not there"))


@query("SELECT event_id, user_id, event_type AS asset FROM events")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows as a search sees them: without their consumptions."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("asset"), F.array(F.struct("value")).alias("consumptions"))
    return tasks.without(rows, tasks.SEARCH_EXCLUDED)


@query(f"""
SELECT task_id, arg_max(status, (t, CASE WHEN t THEN -m ELSE m END, status)) AS status, arg_max(event_id, (t, CASE WHEN t THEN -m ELSE m END, status)) AS event_id
FROM (SELECT user_id AS task_id, {STATUS_SQL} AS status, event_id, epoch_us(ts) AS m, {STATUS_SQL} IN ('completed', 'error') AS t FROM events) GROUP BY task_id
""")
def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table that a log of states stands for: the first terminal state of each task, else its latest."""
    log = states(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("task_status").alias("status"), F.col("ts").alias("event_ts"), "event_id")
    return webhook_states.current_tasks(log, ["event_id"]).select("task_id", "status", "event_id")
