"""Queries on transcripts and audio chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.catalog import query, table
from paperloom.functions import text
from paperloom.operators import chunks, transcripts
from paperloom.plans import documents as plans
from paperloom.providers import stub
from paperloom.sources import audio, files

#: Tokens: words and marks of conversations, half a second each; turns differ in language.
TOKENS_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS seq, content, language,
  CASE WHEN content IN ('.', '?', '!') THEN 'punctuation' ELSE 'word' END AS type FROM
(SELECT conv_id, turn, CASE role WHEN 'user' THEN 'fr' WHEN 'system' THEN 'de' ELSE 'en' END AS language, unnest(range(len(w))) AS i, unnest(w) AS content FROM
 (SELECT *, regexp_extract_all(text, '[.?!]|[^ \\n.?!]+') AS w FROM conversations))
"""
TIMED_SQL = f"SELECT *, seq * 0.5 AS start_time, seq * 0.5 + 0.4 AS end_time FROM ({TOKENS_SQL})"
SENTENCES_SQL = f"""
SELECT conv_id, sentence_no, string_agg(content, ' ' ORDER BY seq) AS sentence, cast(arg_min(start_time, seq) AS DOUBLE) AS start_time, cast(arg_max(end_time, seq) AS DOUBLE) AS end_time FROM
(SELECT *, coalesce(cast(sum(cast(type = 'punctuation' AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS sentence_no FROM ({TIMED_SQL}))
GROUP BY conv_id, sentence_no HAVING max(cast(type = 'punctuation' AS INT)) = 1
"""
NUMBERED_SQL = f"""
SELECT *, max(cast(type = 'punctuation' AS INT)) OVER (PARTITION BY conv_id, sentence_no) AS ended FROM
(SELECT *, coalesce(cast(sum(cast(type = 'punctuation' AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS sentence_no FROM ({TOKENS_SQL}))
"""
COUNTS_SQL = f"SELECT conv_id, sentence_no, language, count(*) AS n FROM ({NUMBERED_SQL}) WHERE ended = 1 GROUP BY ALL"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("role") == "user", "fr").when(F.col("role") == "system", "de").otherwise("en")
    found = F.regexp_extract_all("text", F.lit(r"[.?!]|[^ \n.?!]+"), F.lit(0))
    # a turn's tokens are many times its bytes, so the number of tasks is given, not found by size
    dealt = table(spark, sf_dir, "conversations").repartition(4 * spark.sparkContext.defaultParallelism, "conv_id")
    turns = dealt.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", language.alias("language"), found.alias("words")))).alias("turns"))
    flat = F.flatten(F.transform("turns", lambda t: F.transform(t["words"], lambda w: F.struct(w.alias("content"), t["language"].alias("language")))))
    rows = turns.select("conv_id", F.posexplode(flat).alias("seq", "t")).select("conv_id", F.col("seq").cast("long").alias("seq"), "t.content", "t.language")
    seconds = F.col("seq") * F.lit(0.5)
    return rows.withColumn("type", F.when(F.col("content").isin(".", "?", "!"), "punctuation").otherwise("word")).withColumn("start_time", seconds).withColumn("end_time", seconds + F.lit(0.4))


@query(f"SELECT conv_id, sentence_no, sentence FROM ({SENTENCES_SQL})")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.sentences(tokens(spark, sf_dir), "conv_id").select("conv_id", "sentence_no", "sentence")


@query(f"SELECT conv_id, sentence_no, start_time, round(end_time, 3) AS end_time FROM ({SENTENCES_SQL})")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.sentences(tokens(spark, sf_dir), "conv_id").select("conv_id", "sentence_no", "start_time", F.round("end_time", 3).alias("end_time"))


@query(f"SELECT conv_id, sentence_no, language FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, sentence_no ORDER BY n DESC, language) AS r FROM ({COUNTS_SQL})) WHERE r = 1")
def sentence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.sentence_languages(tokens(spark, sf_dir), "conv_id", cumulative=False)


@query(f"""
WITH c AS ({COUNTS_SQL}), g AS (SELECT * FROM (SELECT DISTINCT conv_id, sentence_no FROM c) JOIN (SELECT DISTINCT conv_id, language FROM c) USING (conv_id)),
r AS (SELECT conv_id, sentence_no, language, sum(coalesce(n, 0)) OVER (PARTITION BY conv_id, language ORDER BY sentence_no) AS n FROM g LEFT JOIN c USING (conv_id, sentence_no, language))
SELECT conv_id, sentence_no, language FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, sentence_no ORDER BY n DESC, language) AS k FROM r WHERE n > 0) WHERE k = 1
""")
def sentence_language_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.sentence_languages(tokens(spark, sf_dir), "conv_id", cumulative=True)


def srt_time_sql(seconds: str) -> str:
    ms = f"(cast(round({seconds} * 1e6) AS BIGINT) // 1000)"
    return f"printf('%02d:%02d:%02d,%03d', ({ms} // 3600000) % 24, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query(f"SELECT event_id, {srt_time_sql('value * 977.0')} AS srt FROM events")
def srt_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.srt_time(F.col("value") * 977.0).alias("srt"))


SRT_SQL = f"""
SELECT conv_id, string_agg(entry, chr(10) ORDER BY sentence_no) AS srt FROM
(SELECT conv_id, sentence_no, cast(row_number() OVER (PARTITION BY conv_id ORDER BY sentence_no) AS VARCHAR) || chr(10) || {srt_time_sql('start_time')} || ' --> ' || {srt_time_sql('end_time')} || chr(10) || sentence || chr(10) AS entry FROM ({SENTENCES_SQL}))
GROUP BY conv_id
"""


@query(SRT_SQL)
def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.subtitles(transcripts.sentences(tokens(spark, sf_dir), "conv_id"), "conv_id")


@query(f"SELECT conv_id, string_agg(sentence, chr(10) ORDER BY sentence_no) AS text FROM ({SENTENCES_SQL}) GROUP BY conv_id")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transcript_text(transcripts.sentences(tokens(spark, sf_dir), "conv_id"), "conv_id")


@query(f"SELECT conv_id, cast(to_json(list(struct_pack(seq, type, start_time := cast(start_time AS DOUBLE), end_time := cast(end_time AS DOUBLE), content, language) ORDER BY seq)) AS VARCHAR) AS json FROM (SELECT conv_id, seq, type, seq * 0.5::DOUBLE AS start_time, seq * 0.5::DOUBLE + 0.4::DOUBLE AS end_time, content, language FROM ({TOKENS_SQL})) GROUP BY conv_id")
def transcript_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transcript_json(tokens(spark, sf_dir), "conv_id")


@query(f"SELECT conv_id, seq, type, content, language, 'job-' || cast(conv_id AS VARCHAR) AS job_id, 60 AS duration FROM ({TOKENS_SQL})")
def transcript_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written as service payloads and read again."""
    alternative = F.array(F.struct(F.lit(0.9).alias("confidence"), "content", "language"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "start_time", "end_time", alternative.alias("alternatives")))), lambda r: r.dropFields("seq"))
    job = F.struct(F.concat(F.lit("job-"), F.col("conv_id").cast("string")).alias("id"), F.lit(60).alias("duration"))
    payloads = tokens(spark, sf_dir).groupBy("conv_id").agg(results.alias("results")).select("conv_id", F.to_json(F.struct(F.lit("2.9").alias("format"), job.alias("job"), "results")).alias("payload"))
    return files.read_transcripts(payloads, "conv_id").select("conv_id", "seq", "type", "content", "language", "job_id", "duration")


@query("""
SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_samples FROM
(SELECT user_id, ts, value < 5 AS quiet, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 5 ORDER BY ts, event_id) AS island FROM events)
WHERE quiet GROUP BY user_id, island HAVING count(*) >= 2
""")
def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.quiet_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 5, "ts", 2)


#: Recordings of an hour, one a user; silences by event.
SILENCES_SQL = "SELECT user_id, (event_id * 7919) % 3600000 AS start_ms, least(3600000, (event_id * 7919) % 3600000 + 750 + event_id % 5000) AS end_ms FROM events WHERE value < 20"
DURATION, MIN_MS, MAX_MS = 3_600_000, 300_000, 600_000
CUTS_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED ({SILENCES_SQL}), c(user_id, cut_at) AS (
 SELECT DISTINCT user_id, cast(0 AS BIGINT) FROM events
 UNION ALL
 SELECT c.user_id, cast(coalesce(min(struct_pack(a := s.start_ms, b := s.end_ms, m := (s.start_ms + s.end_ms) // 2)).m, least({DURATION}, c.cut_at + {MAX_MS})) AS BIGINT)
 FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.end_ms >= least({DURATION}, c.cut_at + {MIN_MS}) AND s.start_ms <= least({DURATION}, c.cut_at + {MAX_MS}) AND (s.start_ms + s.end_ms) // 2 > c.cut_at
 WHERE c.cut_at < {DURATION} GROUP BY c.user_id, c.cut_at)
SELECT user_id, cut_at FROM c WHERE cut_at > 0
"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") * 7919) % DURATION
    silence = F.struct(start.alias("start_ms"), F.least(F.lit(DURATION), start + 750 + F.col("event_id") % 5000).alias("end_ms"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") < 20, silence)).alias("silences")).withColumn("duration_ms", F.lit(DURATION).cast("long"))


@query(CUTS_SQL)
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(spark, sf_dir).select("user_id", F.explode(chunks.cut_points(F.col("duration_ms"), F.col("silences"), MIN_MS, MAX_MS)).alias("cut_at"))


@query(f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY cut_at) - 1 AS chunk_id, coalesce(lag(cut_at) OVER (PARTITION BY user_id ORDER BY cut_at), 0) AS start_ms, cut_at AS end_ms FROM ({CUTS_SQL})")
def chunk_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_ms")
    planned = recordings(spark, sf_dir).withColumn("cuts", chunks.cut_points(d, F.col("silences"), MIN_MS, MAX_MS))
    return planned.select("user_id", F.inline(chunks.chunk_intervals(d, F.col("cuts"), MAX_MS)))


@query("SELECT event_id, 0 AS chunk_id, 0 AS start_ms, 1000 * (event_id % 600 + 1) AS end_ms FROM events")
def short_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings not longer than the longest chunk, one as long: a chunk each, whatever the silences are."""
    duration = (1000 * (F.col("event_id") % 600 + 1)).cast("long")
    silence = F.array(F.struct((duration / 4).cast("long").alias("start_ms"), (duration / 2).cast("long").alias("end_ms")))
    rows = table(spark, sf_dir, "events").select("event_id", duration.alias("duration_ms"), silence.alias("silences"))
    planned = rows.withColumn("cuts", chunks.cut_points(F.col("duration_ms"), F.col("silences"), MIN_MS, MAX_MS))
    return planned.select("event_id", F.inline(chunks.chunk_intervals(F.col("duration_ms"), F.col("cuts"), MAX_MS)))


@query(f"""
SELECT w.user_id, low, high, min(struct_pack(a := start_ms, b := end_ms)).a AS start_ms, min(struct_pack(a := start_ms, b := end_ms)).b AS end_ms FROM
(SELECT user_id, k * 600000 + 300000 AS low, k * 600000 + 600000 AS high FROM (SELECT DISTINCT user_id FROM events), range(6) r(k)) w
LEFT JOIN ({SILENCES_SQL}) s ON s.user_id = w.user_id AND end_ms >= low AND start_ms <= high GROUP BY ALL
""")
def first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings(spark, sf_dir)
    windows = found.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k")).select("user_id", (F.col("k") * 600000 + 300000).alias("low"), (F.col("k") * 600000 + 600000).alias("high"))
    return chunks.first_overlap(windows, found.select("user_id", F.inline("silences")), "user_id")


#: Chunk results: turns, out of order by time in one conversation of three, some blank, some failed.
RESULTS_SQL = """
SELECT conv_id, turn AS chunk_id, CASE WHEN conv_id % 3 = 0 THEN 1000000 - turn * 60000 ELSE turn * 60000 END AS start_ms, CASE WHEN turn % 4 = 1 THEN '  ' ELSE ' ' || text || chr(10) END AS text,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE length(text) * 97 END AS ms, CASE WHEN turn % 5 = 4 THEN 'failed ' || cast(turn AS VARCHAR) END AS error, 'job-' || cast(turn AS VARCHAR) AS job_id FROM conversations
"""


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    start = F.when(F.col("conv_id") % 3 == 0, 1000000 - turn * 60000).otherwise(turn * 60000)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("chunk_id"), start.alias("start_ms"), (start + 60000).alias("end_ms"), F.when(turn % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"),
        F.when(turn % 3 == 1, 0).when(turn % 3 == 2, F.length("text") * 97).cast("long").alias("audio_duration_ms"), F.when(turn % 5 == 4, F.concat(F.lit("failed "), turn.cast("string"))).alias("error"), F.concat(F.lit("job-"), turn.cast("string")).alias("job_id"),
    )


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.merge_chunks(chunk_results(spark, sf_dir), "conv_id", 3.0)


@query(f"SELECT conv_id, coalesce(string_agg(trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY start_ms, chunk_id) FILTER (trim(text, ' ' || chr(10)) <> ''), '') AS merged FROM ({RESULTS_SQL}) GROUP BY conv_id")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("conv_id", "merged")


@query(f"SELECT conv_id, cast(sum(ceil(cast(coalesce(nullif(ms, 0), 60000) AS DOUBLE) / 60000 * 3.0::DOUBLE)) AS BIGINT) AS cost FROM ({RESULTS_SQL}) GROUP BY conv_id")
def chunk_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("conv_id", "cost")


@query("SELECT event_id, cast(ceil(cast(coalesce(ms, 0) AS DOUBLE) / 60 / 1000 * 3.0::DOUBLE) AS BIGINT) AS cost FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id * 980 END AS ms FROM events)")
def job_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 7 != 0, F.col("event_id") * 980)
    return table(spark, sf_dir, "events").select("event_id", chunks.job_cost(ms, 3.0).alias("cost"))


@query(f"SELECT conv_id, arg_min(error, chunk_id) FILTER (error IS NOT NULL) AS first_error FROM ({RESULTS_SQL}) GROUP BY conv_id")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("conv_id", "first_error")


@query(f"SELECT conv_id, arg_min(job_id, struct_pack(a := start_ms, b := chunk_id)) AS job_id FROM ({RESULTS_SQL}) GROUP BY conv_id")
def first_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("conv_id", "job_id")


@query("""
SELECT c.conv_id, CASE WHEN e THEN CASE WHEN c.conv_id % 2 = 0 THEN 'single' ELSE 'error' END ELSE 'chunked' END AS path, CASE WHEN e THEN CASE WHEN c.conv_id % 2 = 0 THEN 'whole' END ELSE t END AS chosen FROM
(SELECT conv_id, max(cast(turn % 5 = 4 AS INT)) = 1 AS e, cast(count(*) AS VARCHAR) AS t FROM conversations GROUP BY conv_id) c
""")
def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import tasks

    rows = chunk_results(spark, sf_dir)
    chunked = rows.groupBy("conv_id").agg(F.min("error").alias("error"), F.count("*").cast("string").alias("text"))
    single = rows.select("conv_id").distinct().where("conv_id % 2 = 0").withColumn("text", F.lit("whole"))
    return tasks.fallback(chunked, single, "conv_id").select("conv_id", "path", "chosen")


@query(f"""
SELECT user_id, string_agg('chunk ' || cast(user_id AS VARCHAR) || ':' || cast(chunk_id AS VARCHAR) || ':' || cast(start_ms AS VARCHAR) || ':' || cast(cut_at AS VARCHAR), chr(10) || chr(10) ORDER BY start_ms) AS merged,
  cast(sum(ceil(cast(cut_at - start_ms AS DOUBLE) / 60000 * 1.0::DOUBLE)) AS BIGINT) AS cost, cast(NULL AS VARCHAR) AS first_error, 'job-' || cast(user_id AS VARCHAR) || '-0' AS job_id
FROM (SELECT user_id, cut_at, row_number() OVER (PARTITION BY user_id ORDER BY cut_at) - 1 AS chunk_id, coalesce(lag(cut_at) OVER (PARTITION BY user_id ORDER BY cut_at), 0) AS start_ms FROM ({CUTS_SQL})) GROUP BY user_id
""")
def transcribe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings planned, transcribed by the stub and merged."""
    return plans.transcribed(recordings(spark, sf_dir), "user_id", stub("chunk "), 1.0, MIN_MS, MAX_MS)


@query("SELECT conv_id, turn, '[translated] ' || trim(text, ' ' || chr(10)) AS result, cast(1 AS BIGINT) AS usage_amount FROM conversations")
def translate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return plans.translated(rows, "id", stub("[translated] ")).select("id.conv_id", "id.turn", "result", "usage_amount")


#: A recording a conversation: each turn speaks for 5 ms a letter and is followed by a pause, of which some are too short to be silences.
SOUND_SQL = """
SELECT conv_id, turn, 5 * length(text) AS loud, 250 * (1 + (conv_id + 3 * turn) % 7) AS pause FROM conversations
"""
PAUSES_SQL = f"""
SELECT conv_id, cast(sum(loud + pause) OVER w - pause AS BIGINT) AS start_ms, cast(sum(loud + pause) OVER w AS BIGINT) AS end_ms, pause FROM ({SOUND_SQL}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""
SOUND_MIN, SOUND_MAX = 6_000, 14_000


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and content: the bytes of a PCM container. The turns are far smaller than the sounds, so their number of tasks is given, not found by size."""
    dealt = table(spark, sf_dir, "conversations").repartition(4 * spark.sparkContext.defaultParallelism, "conv_id")
    turns = dealt.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (5 * F.length("text")).alias("loud"), (250 * (1 + (F.col("conv_id") + 3 * F.col("turn")) % 7)).cast("int").alias("pause")))).alias("turns"))

    def recorded(turns: list[dict]) -> bytes:
        return audio.encode(audio.tone([x for r in turns for x in ((r["loud"], True), (r["pause"], False))]))

    return files.make_files(turns, ["conv_id"], ["turns"], recorded)


@query(f"SELECT conv_id, (SELECT cast(max(end_ms) AS BIGINT) FROM ({PAUSES_SQL}) e WHERE e.conv_id = p.conv_id) AS duration_ms, start_ms, end_ms FROM ({PAUSES_SQL}) p WHERE pause >= 750")
def sound_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of 750 ms and more, 40 dB below full scale, from the bytes of recordings."""
    return audio.sound_table(sounds(spark, sf_dir), "conv_id").select("conv_id", "duration_ms", F.inline("silences"))


SOUND_CUTS_SQL = f"""
WITH RECURSIVE p AS MATERIALIZED ({PAUSES_SQL}), d AS (SELECT conv_id, max(end_ms) AS d FROM p GROUP BY conv_id), s AS (SELECT conv_id, start_ms, end_ms FROM p WHERE pause >= 750), c(conv_id, cut_at) AS (
 SELECT conv_id, cast(0 AS BIGINT) FROM d
 UNION ALL
 SELECT c.conv_id, cast(coalesce(min(struct_pack(a := s.start_ms, b := s.end_ms, m := (s.start_ms + s.end_ms) // 2)).m, least(d.d, c.cut_at + {SOUND_MAX})) AS BIGINT)
 FROM c JOIN d ON d.conv_id = c.conv_id LEFT JOIN s ON s.conv_id = c.conv_id AND s.end_ms >= least(d.d, c.cut_at + {SOUND_MIN}) AND s.start_ms <= least(d.d, c.cut_at + {SOUND_MAX}) AND (s.start_ms + s.end_ms) // 2 > c.cut_at
 WHERE c.cut_at < d.d GROUP BY c.conv_id, c.cut_at, d.d)
SELECT conv_id, row_number() OVER w - 1 AS chunk_id, start_ms, end_ms, printf('chunk_%04d.wav', row_number() OVER w - 1) AS name, cast(8 * (end_ms - start_ms) AS BIGINT) AS n_samples FROM (
 SELECT conv_id, coalesce(lag(cut_at) OVER (PARTITION BY conv_id ORDER BY cut_at), 0) AS start_ms, cut_at AS end_ms FROM c JOIN d USING (conv_id) WHERE cut_at > 0 AND d > {SOUND_MAX}
 UNION ALL SELECT conv_id, 0, d FROM d WHERE d <= {SOUND_MAX}) WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms)
"""


@query(SOUND_CUTS_SQL)
def sound_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bytes to chunks: decoded, silences found, cut points planned, and each chunk a container again, of so many samples."""
    cut = audio.cut_chunks(sounds(spark, sf_dir), "conv_id", SOUND_MIN, SOUND_MAX)
    return cut.select("conv_id", "chunk_id", "start_ms", "end_ms", "name", (F.octet_length("content") - 44).cast("long").alias("n_samples"))


@query(SRT_SQL)
def srt_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles from an array of timings and one of sentences, which must be as long."""
    found = transcripts.sentences(tokens(spark, sf_dir), "conv_id")
    rows = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", F.array("start_time", "end_time").alias("t"), "sentence"))).alias("rows"))
    return rows.select("conv_id", transcripts.subtitles_of_arrays(F.transform("rows", lambda r: r["t"]), F.transform("rows", lambda r: r["sentence"])).alias("srt"))


@query("SELECT event_id, cast((event_id % 90) * 60 * 1000 AS BIGINT) AS ms FROM events")
def minutes_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", chunks.minutes_to_ms(F.col("event_id") % 90).alias("ms"))
