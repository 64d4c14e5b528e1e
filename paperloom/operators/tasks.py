"""Task state from events, webhooks matched to tasks, listings and result views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import or_default

NOT_COMPLETED = "Task is not completed yet"
TERMINAL = ["done", "rejected"]


def final_states(events: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest event of each task. Aggregates before the exchange, so a task with many events sends one row a partition."""
    latest = F.max(F.struct(at, tie, *columns)).alias("last")
    return events.groupBy(key).agg(latest).select(key, F.col(f"last.{at}").alias(at), F.col(f"last.{tie}").alias(tie), *[F.col(f"last.{c}").alias(c) for c in columns])


def task_page(tasks: DataFrame, order: list[Column], offset: int = 0, limit: int = 10, max_limit: int = 100, user: object = None, user_col: str = "user_id") -> DataFrame:
    """A page of a listing, of one user's tasks if `user` is given. The order decides on all rows, so it should be total."""
    if offset < 0 or not 1 <= limit <= max_limit:
        raise ValueError("offset must be 0 or more, limit from 1 to the maximum")
    if user is not None:
        tasks = tasks.where(F.col(user_col) == F.lit(user))
    return tasks.orderBy(*order).offset(offset).limit(limit)


def task_lookup(tasks: DataFrame, key: str, value: object) -> DataFrame:
    return tasks.where(F.col(key) == F.lit(value))


def result_view(status: Column, result: Column, message: str = NOT_COMPLETED) -> Column:
    return F.when(F.coalesce(status, F.lit("")) != "completed", F.lit(message)).otherwise(F.coalesce(result, F.lit("")))


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


#: What a webhook's error says.
NO_JOB, OTHER_JOB, FAILED_JOB = "Transcription job ID is required", "Transcription job ID does not match", "Transcription job status is error"


def match_webhooks(webhooks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each webhook with its task's job id, and the outcome: ok, or why it is an error.

    Columns: task_id, job_id, status (the payload's), and perhaps route_status (the address's; its
    errors have an empty message); task_id, task_job_id. A task without a job id gives the same
    error whatever the webhook says.
    """
    job, own = F.col("job_id"), or_default(F.col("task_job_id"), F.lit(None))
    routed = F.col("route_status") if "route_status" in webhooks.columns else F.lit(None).cast("string")
    outcome = (
        F.when(own.isNull(), F.lit(NO_JOB))
        .when(F.coalesce(routed, F.lit("")) == "error", F.lit(""))
        .when(~F.coalesce(own == job, F.lit(False)), F.lit(OTHER_JOB))
        .when(F.coalesce(F.col("status"), F.lit("")) != "completed", F.lit(FAILED_JOB))
        .otherwise(F.lit("ok"))
    )
    return webhooks.join(tasks, "task_id", "left").withColumn("outcome", outcome)


def first_webhooks(webhooks: DataFrame, at: str, tie: str, columns: list[str]) -> DataFrame:
    """One webhook of each task and job, the earliest, so that a repeat is not metered again."""
    least = F.min(F.struct(at, tie, *columns)).alias("first")
    return webhooks.groupBy("task_id", "job_id").agg(least).select("task_id", "job_id", F.col(f"first.{at}").alias(at), F.col(f"first.{tie}").alias(tie), *[F.col(f"first.{c}").alias(c) for c in columns])


def owner(user_id: Column, caller: Column, may_act_for_others: Column) -> tuple[Column, Column]:
    """The owner (the caller by default), and whether the caller may create the task."""
    who = F.coalesce(user_id, caller)
    return who, F.coalesce(who == caller, F.lit(False)) | F.coalesce(may_act_for_others, F.lit(False))


def fallback(chunked: DataFrame, single: DataFrame, key: str, enabled: bool = True) -> DataFrame:
    """The chunked result; where it failed, the single job's if enabled, else an error."""
    both = chunked.join(single.select(key, F.col("text").alias("single_text")), key, "left")
    failed = F.col("error").isNotNull()
    path = F.when(~failed, F.lit("chunked")).when(F.lit(enabled) & F.col("single_text").isNotNull(), F.lit("single")).otherwise(F.lit("error"))
    return both.withColumn("path", path).withColumn("chosen", F.when(F.col("path") == "chunked", F.col("text")).when(F.col("path") == "single", F.col("single_text")))


def collision_free(paths: DataFrame, archive: str, path: str, order: str) -> DataFrame:
    """Output paths made unique within an archive: a repeat gets its number before the suffix. Ordered by the member's own path."""
    n = F.row_number().over(Window.partitionBy(archive, path).orderBy(order)).cast("long")
    return paths.withColumn("repeat_no", n).withColumn(path, F.when(F.col("repeat_no") == 1, F.col(path)).otherwise(F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit("-"), F.col("repeat_no").cast("string"), F.lit(".md"))))


#: Columns that a webhook's payload leaves out, and that a search leaves out besides the fields that are searched by themselves.
WEBHOOK_EXCLUDED: tuple[str, ...] = ()
SEARCH_EXCLUDED = ("consumptions",)


def without(rows: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """All columns but the excluded ones; names that are not there are no error."""
    return rows.drop(*excluded)


def insert_document(rows: DataFrame, key: str, status: str = "init", **fixed: Column) -> DataFrame:
    """key and `document`: each row as it is inserted, a JSON object of its columns that are not null, then `fixed` ones, then the status."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in fixed and c != "task_status"]
    document = F.struct(*columns, *(c.alias(name) for name, c in fixed.items()), F.lit(status).alias("task_status"))
    return rows.select(key, F.to_json(document, {"ignoreNullFields": "true"}).alias("document"))


def webhook_payload(rows: DataFrame, key: str, excluded: tuple[str, ...] = WEBHOOK_EXCLUDED) -> DataFrame:
    """key and `payload`: what a task's webhook sends, nulls included."""
    return rows.select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in without(rows, excluded).columns]), {"ignoreNullFields": "false"}).alias("payload"))
