"""Whole tasks as plans: recognition, translation, transcription."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import mime as mimes
from paperloom.functions.text import normalize_text
from paperloom.operators import billing, chunks, pages
from paperloom.providers import Provider, apply_function, apply_provider
from paperloom.sources.archives import explode_archives
from paperloom.sources.office import office_text


def routed(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with `mime` and `route`."""
    return files.withColumn("mime", mimes.sniff(F.col(content))).withColumn("route", mimes.route(F.col("mime")))


def recognise_pages(page_rows: DataFrame, key: str, recognise: Provider, enhance: Provider | None = None) -> DataFrame:
    """Pages (key, page_no, content) to one text a document, with its units. A page that fails is null and still counts."""
    done = apply_provider(page_rows.select(key, "page_no", "content"), recognise, "content", then=enhance)
    return pages.merge_pages(done, key, text="text")


def archive_texts(files: DataFrame, key: str, recognise: Provider) -> DataFrame:
    """Archives' members to text: office documents are read, images go through the model, other types end up empty. key, member_path, text, error."""
    opened = explode_archives(files.select(key, "content", "mime"))
    typed = opened.where("member IS NOT NULL").select(key, "member_path", F.col("member").alias("content")).transform(routed)
    direct = office_text(typed.where("route <> 'ocr'")).select(key, "member_path", "text", "error")
    seen = apply_provider(typed.where("route = 'ocr'"), recognise, "content").select(key, "member_path", "text", "error")
    failed = opened.where("member IS NULL").select(key, "member_path", F.lit(None).cast("string").alias("text"), "error")
    return direct.unionByName(seen).unionByName(failed)


def process_members(files: DataFrame, key: str, make: Provider, strict: bool = False, concurrency: int = 10) -> DataFrame:
    """key, member_path, text, error: a caller's function of each member's path and bytes, plain or a coroutine, ten at a time in a task.

    A member that fails is a row with its error, or fails the whole with `strict`; archives that cannot be read are rows as well.
    """
    opened = explode_archives(files.select(key, "content", "mime")).select(key, "member_path", "member", F.col("error").alias("unreadable"))
    done = apply_function(opened.where("member IS NOT NULL").select(key, "member_path", "member"), make, ["member_path", "member"], strict=strict, concurrency=concurrency)
    failed = opened.where("member IS NULL").select(key, "member_path", F.lit(None).cast("string").alias("text"), F.col("unreadable").alias("error"))
    return done.select(key, "member_path", "text", "error").unionByName(failed)


def translated(tasks: DataFrame, key: str, translate: Provider) -> DataFrame:
    """key, result, usage_amount: one unit a text, whether the model answered or not."""
    done = apply_provider(tasks.select(key, "text"), translate, "text", target="translation")
    return done.select(key, normalize_text(F.coalesce("translation", F.lit(""))).alias("result"), F.lit(1).cast("long").alias("usage_amount"), "error")


def transcribed(recordings: DataFrame, key: str, transcribe: Provider, price: float, min_ms: int, max_ms: int) -> DataFrame:
    """Recordings (key, duration_ms, silences) to chunks, texts and costs. The model sees `key:chunk_id:start:end`, a staged chunk's name."""
    duration = F.col("duration_ms")
    planned = recordings.withColumn("cuts", chunks.cut_points(duration, F.col("silences"), min_ms, max_ms)).select(key, F.inline(chunks.chunk_intervals(duration, F.col("cuts"), max_ms)))
    named = planned.withColumn("source", F.concat_ws(":", F.col(key).cast("string"), "chunk_id", "start_ms", "end_ms"))
    done = apply_provider(named, transcribe, "source").withColumn("job_id", F.concat_ws("-", F.lit("job"), F.col(key).cast("string"), "chunk_id")).withColumn("audio_duration_ms", F.lit(None).cast("long"))
    return chunks.merge_chunks(done, key, price)


def gated(tasks: DataFrame, quotas: DataFrame, owner: str, needed: str, asset: str | None = None, variant: str | None = None) -> DataFrame:
    """All tasks before any model is called, with `message`: null where the owner's quota suffices, else why the task is an error."""
    found = billing.gate(tasks, quotas, owner, F.col(needed), asset, variant)
    return found.withColumn("message", F.when(~F.col("allowed"), F.lit(pages.NO_QUOTA))).drop("allowed", "quota", "is_unlimited")
