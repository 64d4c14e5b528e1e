import datetime

from paperloom import schemas
from paperloom.operators.tasks import match_webhooks
from paperloom.streaming import webhooks as w

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


ROWS = [("a", None, "j1", "completed", at(0)), ("a", None, "j1", "completed", at(1)), ("b", None, "x", "completed", at(2)), ("c", None, None, "error", at(3)), ("a", None, "j1", "completed", at(4))]


def test_stream_gives_the_batch_result(spark, tmp_path):
    for k, part in enumerate((ROWS[:2], ROWS[2:])):
        spark.createDataFrame(part, schemas.WEBHOOK_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    own = spark.createDataFrame([("a", "j1"), ("b", "j2"), ("c", None)], "task_id string, task_job_id string")
    stream = w.matched_stream(w.read_webhooks(spark, f"{tmp_path}/in"), own)
    w.write_batches(stream, f"{tmp_path}/check", lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).awaitTermination()
    got = sorted((r.task_id, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = match_webhooks(spark.createDataFrame(ROWS, schemas.WEBHOOK_EVENTS).dropDuplicates(["task_id", "job_id"]), own)
    assert got == sorted((r.task_id, r.outcome) for r in batch.collect())
    assert w.metered(spark.read.parquet(f"{tmp_path}/out")).count() == 1


def test_states_are_final_and_time_out(spark, tmp_path):
    steps = [
        [("a", None, "j", "processing", at(0)), ("b", None, "j", "processing", at(0))],
        [("a", None, "j", "completed", at(1)), ("a", None, "j", "error", at(2))],
        [("z", None, "j", "processing", at(60 * 24 * 3))],
        [("z", None, "j", "processing", at(60 * 24 * 3 + 1))],
    ]
    (tmp_path / "in").mkdir()
    stream = w.task_states(w.read_webhooks(spark, f"{tmp_path}/in"), timeout="1 day", delay="1 minute")
    for rows in steps:  # one run for each step, from the same checkpoint
        spark.createDataFrame(rows, schemas.WEBHOOK_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        w.write_batches(stream, f"{tmp_path}/check", lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).awaitTermination()
    got = sorted((r.task_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "completed"), ("a", "processing"), ("b", "processing"), ("b", "timed out"), ("z", "processing")]
