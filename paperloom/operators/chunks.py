"""Audio chunks: quiet runs, cut points over silences, intervals, and merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import joined_in_order, normalize_text, strip


def quiet_runs(samples: DataFrame, key: str, order: list[str], quiet: Column, at: str, min_run: int) -> DataFrame:
    """Runs of at least min_run quiet samples: gaps and islands by two row numbers."""
    everything = Window.partitionBy(key).orderBy(*order)
    alike = Window.partitionBy(key, "quiet").orderBy(*order)
    islands = samples.withColumn("quiet", F.coalesce(quiet, F.lit(False))).withColumn("island", F.row_number().over(everything) - F.row_number().over(alike)).where("quiet")
    return islands.groupBy(key, "island").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n_samples")).where(F.col("n_samples") >= min_run).drop("island")


def cut_points(duration: Column, silences: Column, min_ms: int, max_ms: int) -> Column:
    """Cut points of one recording: the middle of the first silence that meets [cursor + min, cursor + max], else cursor + max.

    Silences (start_ms, end_ms) are clamped and sorted. Middles that do not pass the cursor are
    skipped, so planning ends: a silence is used once at most, every other step moves on by max.
    """
    clamped = F.array_sort(F.transform(F.coalesce(silences, F.array()), lambda s: F.struct(F.greatest(F.lit(0), s["start_ms"]).cast("long").alias("start_ms"), F.least(duration, s["end_ms"]).cast("long").alias("end_ms"))))
    state = F.struct(F.lit(0).cast("long").alias("cursor"), F.array().cast("array<bigint>").alias("cuts"))

    def step(s: Column, _: Column) -> Column:
        low, high = F.least(duration, s["cursor"] + min_ms), F.least(duration, s["cursor"] + max_ms)
        middle = lambda x: F.floor((x["start_ms"] + x["end_ms"]) / 2)
        found = F.filter(clamped, lambda x: (x["end_ms"] >= low) & (x["start_ms"] <= high) & (middle(x) > s["cursor"]))
        cut = F.coalesce(middle(F.get(found, F.lit(0))), high).cast("long")
        moved = F.struct(cut.alias("cursor"), F.array_append(s["cuts"], cut).alias("cuts"))
        return F.when(s["cursor"] < duration, moved).otherwise(s)

    steps = F.size(clamped) + F.ceil(duration / max_ms).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), state, step)["cuts"]


def chunk_intervals(duration: Column, cuts: Column, max_ms: int) -> Column:
    """Half-open intervals between cuts; one for a recording not longer than max."""
    between = F.transform(cuts, lambda c, i: F.struct(i.cast("long").alias("chunk_id"), F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)).cast("long").alias("start_ms"), c.alias("end_ms")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("start_ms"), duration.cast("long").alias("end_ms")))
    return F.when(duration <= max_ms, whole).otherwise(between)


def first_overlap(windows: DataFrame, silences: DataFrame, key: str) -> DataFrame:
    """For each window (low, high) of a key, the first silence by start and end that overlaps it, ends included."""
    both = windows.join(silences, key, "left")
    meets = (F.col("end_ms") >= F.col("low")) & (F.col("start_ms") <= F.col("high"))
    least = F.min(F.when(meets, F.struct("start_ms", "end_ms")))
    return both.groupBy(key, "low", "high").agg(least.alias("s")).select(key, "low", "high", F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"))


def minutes_to_ms(minutes: Column) -> Column:
    """Settings in minutes as milliseconds; whole minutes exactly."""
    return (minutes * 60 * 1000).cast("long")


def chunk_milliseconds(job_ms: Column, start_ms: Column, end_ms: Column) -> Column:
    """The job's own duration; the planned one where it is missing or zero."""
    return F.coalesce(F.nullif(job_ms, F.lit(0)), end_ms - start_ms)


def chunk_cost(ms: Column, price: float) -> Column:
    return F.ceil(ms / 60_000 * price).cast("long")


def job_cost(ms: Column, price: float) -> Column:
    """Operands in this order; another can round to another ceiling."""
    return F.ceil(F.coalesce(ms, F.lit(0)) / 60 / 1000 * price).cast("long")


def merge_chunks(results: DataFrame, key: str, price: float) -> DataFrame:
    """One row a task: stripped texts by start and id, blank ones dropped, two line feeds between, normalised; the sum of rounded-up chunk costs; first error and first job."""
    order = F.struct("start_ms", "chunk_id")
    ms = chunk_milliseconds(F.col("audio_duration_ms"), F.col("start_ms"), F.col("end_ms"))
    return results.groupBy(key).agg(
        normalize_text(joined_in_order(order, strip(F.col("text")), "\n\n")).alias("merged"),
        F.sum(chunk_cost(ms, price)).alias("cost"),
        F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("chunk_id"))).alias("first_error"),
        F.min_by("job_id", order).alias("job_id"),
    )
