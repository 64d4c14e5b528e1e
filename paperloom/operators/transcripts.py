"""Transcripts: sentences from tokens, their spans and languages, subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import joined_in_order, srt_time


def _closes() -> Column:
    return (F.col("type") == "punctuation") & F.col("content").isin(".", "?", "!")


def _numbered(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens with the number of their sentence, and whether they close it."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("closes", _closes()).withColumn("sentence_no", F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0).cast("long")))


def with_sentence(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens with the number of their sentence; tokens after the last terminal mark are dropped."""
    ends = F.max("closes").over(Window.partitionBy(key, "sentence_no"))
    return _numbered(tokens, key).withColumn("ended", ends).where("ended").drop("closes", "ended")


def sentences(tokens: DataFrame, key: str) -> DataFrame:
    """key, sentence_no, sentence, start_time, end_time. Tokens are joined by one space, marks too."""
    return with_sentence(tokens, key).groupBy(key, "sentence_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("sentence"),
        F.min_by("start_time", "seq").alias("start_time"),
        F.max_by("end_time", "seq").alias("end_time"),
    )


def sentence_languages(tokens: DataFrame, key: str, cumulative: bool) -> DataFrame:
    """The most frequent language up to each sentence's end (cumulative), or within the sentence; ties go to the first by name.

    Tokens are sorted once; what follows has a row for each sentence and language.
    """
    per = _numbered(tokens, key).groupBy(key, "sentence_no", "language").agg(F.count("*").alias("n"), F.max("closes").alias("closes"))
    counts = per.withColumn("ended", F.max("closes").over(Window.partitionBy(key, "sentence_no"))).where("ended").select(key, "sentence_no", "language", "n")
    if cumulative:
        # a row for every sentence and language seen in the task, so that counts carry over
        seen = counts.where(F.col(key).isNotNull()).withColumn("seen", F.collect_set("language").over(Window.partitionBy(key)))
        here = F.map_from_entries(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n"))))
        grid = seen.groupBy(key, "sentence_no").agg(F.first("seen").alias("seen"), here.alias("here")).select(key, "sentence_no", "here", F.explode("seen").alias("language"))
        running = Window.partitionBy(key, "language").orderBy("sentence_no")
        counts = grid.withColumn("n", F.sum(F.coalesce(F.col("here")[F.col("language")], F.lit(0))).over(running)).where("n > 0")
    return counts.groupBy(key, "sentence_no").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("language"))).alias("best")).select(key, "sentence_no", F.col("best.language").alias("language"))


def subtitles(found: DataFrame, key: str) -> DataFrame:
    """key, srt: numbered entries with times, by sentence number; and the text, one sentence a line."""
    entry = F.concat_ws("\n", F.row_number().over(Window.partitionBy(key).orderBy("sentence_no")).cast("string"), F.concat(srt_time(F.col("start_time")), F.lit(" --> "), srt_time(F.col("end_time"))), F.col("sentence"), F.lit(""))
    return found.withColumn("entry", entry).groupBy(key).agg(joined_in_order(F.col("sentence_no"), F.col("entry"), "\n").alias("srt"))


def transcript_text(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(joined_in_order(F.col("sentence_no"), F.col("sentence"), "\n").alias("text"))


def transcript_json(tokens: DataFrame, key: str) -> DataFrame:
    """key, json: the tokens in order as a JSON array."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "type", "start_time", "end_time", "content", "language")))
    return tokens.groupBy(key).agg(F.to_json(rows).alias("json"))


def subtitles_of_arrays(timings: Column, sentences: Column) -> Column:
    """SRT of an array of (start, end) and one of sentences, in their order. Arrays of different lengths fail the query; null or empty ones give an empty text."""
    pairs = F.arrays_zip(timings.alias("t"), sentences.alias("s"))
    entries = F.transform(pairs, lambda p, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(srt_time(F.get(p["t"], F.lit(0))), F.lit(" --> "), srt_time(F.get(p["t"], F.lit(1)))), F.coalesce(p["s"], F.lit("")), F.lit("")))
    alike = F.coalesce(F.size(timings), F.lit(0)) == F.coalesce(F.size(sentences), F.lit(0))
    return F.when(alike, F.coalesce(F.array_join(entries, "\n"), F.lit(""))).otherwise(F.raise_error(F.lit("timings and sentences differ in number")))
