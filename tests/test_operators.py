import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import billing, chunks, languages, pages, tasks, transcripts
from paperloom.plans import documents as plans
from paperloom.providers import apply_provider, stub


def test_pages_keep_order_and_count_failures(spark):
    rows = spark.createDataFrame([(1, 3, "b"), (1, 0, "a"), (1, 1, None), (1, 2, ""), (2, 0, None)], "task long, page_no long, content string")
    got = {r.task: (r.merged, r.units) for r in pages.merge_pages(rows, "task").collect()}
    assert got == {1: ("a\n\nb", 4), 2: ("", 1)}


def plain_cuts(d, silences, low, high):
    silences = sorted((max(0, a), min(d, b)) for a, b in silences)
    out, cursor = [], 0
    while cursor < d:
        lo, hi = min(d, cursor + low), min(d, cursor + high)
        cut = next((m for a, b in silences if b >= lo and a <= hi and (m := math.floor((a + b) / 2)) > cursor), hi)
        out.append(cut)
        cursor = cut
    return out


def cuts(spark, cases, low, high):
    rows = [(k, d, [{"start_ms": a, "end_ms": b} for a, b in s]) for k, (d, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, d long, s array<struct<start_ms:long,end_ms:long>>")
    planned = df.select("k", "d", chunks.cut_points(F.col("d"), F.col("s"), low, high).alias("cuts"))
    got = planned.select("k", "cuts", chunks.chunk_intervals(F.col("d"), F.col("cuts"), high).alias("i")).orderBy("k").collect()
    return [(r.cuts, [(x.start_ms, x.end_ms) for x in r.i]) for r in got]


MIN = 60_000


def test_cut_literals(spark):
    cases = [(25 * MIN, []), (12 * MIN, [(7 * MIN, 7 * MIN + 2000)]), (12 * MIN, [(11 * MIN + 50_000, 12 * MIN)]), (9 * MIN, [(MIN, 2 * MIN)])]
    got = cuts(spark, cases, 5 * MIN, 10 * MIN)
    assert got[0][0] == [10 * MIN, 20 * MIN, 25 * MIN]
    assert got[1][0] == [7 * MIN + 1000, 12 * MIN]
    assert got[2][0] == [10 * MIN, 11 * MIN + 55_000, 12 * MIN]
    assert got[3][1] == [(0, 9 * MIN)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 400), st.lists(st.tuples(st.integers(-5, 400), st.integers(0, 60)).map(lambda x: (x[0], x[0] + x[1])), max_size=6)), min_size=1, max_size=20))
def test_cuts_against_a_loop(spark, cases):
    for (d, s), (found, intervals) in zip(cases, cuts(spark, cases, 20, 50)):
        assert found == plain_cuts(d, s, 20, 50)
        assert intervals[0][0] == 0 and intervals[-1][1] == d and all(a[1] == b[0] for a, b in zip(intervals, intervals[1:]))


def test_chunks_merge_in_order_with_costs(spark):
    rows = [(1, 1, 60, 90, "j1", " b \n", 980_000, None), (1, 0, 0, 60, "j0", "a", None, None), (1, 2, 90, 120, "j2", "  ", 0, "late"), (1, 3, 60, 90, "j3", "c", 1, "early")]
    df = spark.createDataFrame(rows, "task long, chunk_id int, start_ms long, end_ms long, job_id string, text string, audio_duration_ms long, error string")
    r = chunks.merge_chunks(df, "task", 3.0).first()
    assert r.merged == "a\n\nb\n\nc" and r.job_id == "j0" and r.first_error == "late" and r.cost == 49 + 1 + 1 + 1


def test_cost_operand_order(spark):
    r = spark.range(1).select(chunks.job_cost(F.lit(980_000), 3.0).alias("job"), chunks.chunk_cost(F.lit(980_000), 3.0).alias("chunk"), chunks.job_cost(F.lit(None).cast("long"), 3.0).alias("none")).first()
    assert (r.job, r.chunk, r.none) == (50, 49, 0)


def tokens(spark, words, languages=None):
    rows = [("t", k, "punctuation" if w in ".?!," else "word", k / 1.0, k + 0.5, w, (languages or ["en"] * len(words))[k]) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "task_id string, seq long, type string, start_time double, end_time double, content string, language string")


def test_sentences_drop_the_tail(spark):
    t = tokens(spark, "Hello . Bye , now ! tail".split())
    got = transcripts.sentences(t, "task_id").orderBy("sentence_no").collect()
    assert [(r.sentence, r.start_time, r.end_time) for r in got] == [("Hello .", 0, 1.5), ("Bye , now !", 2, 5.5)]
    found = transcripts.sentences(t, "task_id")
    assert transcripts.transcript_text(found, "task_id").first().text == "Hello .\nBye , now !"
    assert transcripts.subtitles(found, "task_id").first().srt == "1\n00:00:00,000 --> 00:00:01,500\nHello .\n\n2\n00:00:02,000 --> 00:00:05,500\nBye , now !\n"


def test_languages_running_and_by_sentence(spark):
    t = tokens(spark, "a b . c .".split(), ["en", "en", "en", "fr", "fr"])
    assert [r.language for r in transcripts.sentence_languages(t, "task_id", True).orderBy("sentence_no").collect()] == ["en", "en"]
    assert [r.language for r in transcripts.sentence_languages(t, "task_id", False).orderBy("sentence_no").collect()] == ["en", "fr"]


def test_quota(spark):
    owed = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5)], "user_id string, pages long")
    quotas = spark.createDataFrame([("a", Decimal(5), False), ("b", Decimal(4), False), ("c", None, True)], "user_id string, quota decimal(38,18), is_unlimited boolean")
    assert {r.user_id: r.allowed for r in billing.gate(owed, quotas, "user_id", F.col("pages")).collect()} == {"a": True, "b": False, "c": True, "d": False}
    assert {r.user_id: r.message for r in plans.gated(owed, quotas, "user_id", "pages").collect()} == {"a": None, "b": "insufficient_quota", "c": None, "d": "insufficient_quota"}


def test_usage(spark):
    df = spark.createDataFrame([(1, "u", None, 1.1), (2, None, None, 1.0), (3, None, "e", 0.0), (4, "u", None, 2.2)], "usage_id long, user_id string, enrollment_id string, x double").withColumn("amount", billing.exact_decimal(F.col("x")))
    problems = {r[0]: r[1] for r in df.select("usage_id", billing.usage_problem(F.col("user_id"), F.col("enrollment_id"), F.col("amount"))).collect()}
    assert problems == {1: None, 2: "no owner", 3: "amount not positive", 4: None}
    net = billing.net_usage(df, spark.createDataFrame([(4,), (None,)], "usage_id long"))
    assert sorted(r.usage_id for r in net.collect()) == [1, 2, 3]
    assert billing.usage_totals(df.where("user_id = 'u'"), "user_id").first().amount == Decimal("3.3")


def test_webhooks(spark):
    hooks = spark.createDataFrame([("t", "j", "completed", 2), ("t", "j", "completed", 1), ("t", "x", "completed", 1), ("n", "j", "completed", 1), ("n", None, "error", 1), ("t", "j", "error", 3), ("?", "j", "completed", 1)], "task_id string, job_id string, status string, ts int")
    own = spark.createDataFrame([("t", "j"), ("n", None)], "task_id string, task_job_id string")
    got = {(r.task_id, r.job_id, r.status): r.outcome for r in tasks.match_webhooks(hooks, own).collect()}
    assert got["t", "j", "completed"] == "ok" and got["t", "x", "completed"] == "Transcription job ID does not match"
    # a task without a job id, or no task at all: the same error for every webhook
    assert {got["n", None, "error"], got["n", "j", "completed"], got["?", "j", "completed"]} == {"Transcription job ID is required"}
    routed = tasks.match_webhooks(hooks.withColumn("route_status", F.lit("error")), own)
    assert {(r.task_id, r.outcome) for r in routed.collect()} == {("t", ""), ("n", tasks.NO_JOB), ("?", tasks.NO_JOB)}
    assert got["t", "j", "error"] == "Transcription job status is error"
    once = tasks.first_webhooks(hooks, "ts", "status", [])
    assert once.count() == 5 and once.where("task_id = 't' AND job_id = 'j'").first().ts == 1


def test_states_views_and_owners(spark):
    df = spark.createDataFrame([("a", 1, 1, "init", None), ("a", 2, 1, "completed", "r"), ("a", 2, 0, "error", None), ("b", 1, 0, "completed", None), ("c", 1, 0, None, "x")], "task string, ts int, n int, status string, result string")
    last = tasks.final_states(df, "task", "ts", "n", ["status", "result"])
    assert {r.task: r.body for r in last.select("task", tasks.result_view(F.col("status"), F.col("result")).alias("body")).collect()} == {"a": "r", "b": "", "c": tasks.NOT_COMPLETED}
    who, allowed = tasks.owner(F.lit(None).cast("string"), F.lit("me"), F.lit(False))
    assert tuple(spark.range(1).select(who, allowed).first()) == ("me", True)
    who, allowed = tasks.owner(F.lit("you"), F.lit("me"), F.lit(None).cast("boolean"))
    assert tuple(spark.range(1).select(who, allowed).first()) == ("you", False)
    with pytest.raises(ValueError):
        tasks.task_page(df, [F.col("task")], limit=0)


def test_fallback_and_collisions(spark):
    chunked = spark.createDataFrame([(1, "t", None), (2, None, "bad"), (3, None, "bad")], "k int, text string, error string")
    single = spark.createDataFrame([(2, "whole")], "k int, text string")
    assert {r.k: (r.path, r.chosen) for r in tasks.fallback(chunked, single, "k").collect()} == {1: ("chunked", "t"), 2: ("single", "whole"), 3: ("error", None)}
    assert {r.path for r in tasks.fallback(chunked, single, "k", enabled=False).collect()} == {"chunked", "error"}
    paths = spark.createDataFrame([("z", "a.docx", "a.md"), ("z", "a.pdf", "a.md"), ("y", "a.pdf", "a.md")], "zip string, member string, out string")
    assert sorted((r.zip, r.member, r.out) for r in tasks.collision_free(paths, "zip", "out", "member").collect()) == [("y", "a.pdf", "a.md"), ("z", "a.docx", "a.md"), ("z", "a.pdf", "a-2.md")]


def test_languages_table(spark):
    assert languages.languages(spark).count() == 23
    got = languages.with_language(spark.createDataFrame([("cmn",), ("xx",)], "s string"), "s").collect()
    assert {r.s: r.language_value for r in got} == {"cmn": "Mandarin", "xx": None}


def failing():
    def run(value):
        if value == "bad":
            raise ValueError("no text")
        return value

    return run


def test_provider_isolates_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, x string")
    got = {r.k: (r.text, r.error) for r in apply_provider(df, failing, "x", then=stub("+")).collect()}
    assert got == {1: ("+a", None), 2: (None, "no text"), 3: (None, None)}
    with pytest.raises(Exception, match="no text"):
        apply_provider(df, failing, "x", strict=True).collect()


def test_retries(spark):
    def make():
        left = [2]

        def run(value):
            left[0] -= 1
            if left[0] >= 0:
                raise OSError("busy")
            return value

        return run

    df = spark.createDataFrame([(1, "a")], "k int, x string")
    assert apply_provider(df, make, "x", retries=1).first().error == "busy" and apply_provider(df, make, "x", retries=2).first().text == "a"


def test_transcription_and_translation_plans(spark):
    rec = spark.createDataFrame([(7, 25 * MIN, [])], "task long, duration_ms long, silences array<struct<start_ms:long,end_ms:long>>")
    r = plans.transcribed(rec, "task", stub(), 1.0, 5 * MIN, 10 * MIN).first()
    assert r.merged.split("\n\n") == [f"7:0:0:{10 * MIN}", f"7:1:{10 * MIN}:{20 * MIN}", f"7:2:{20 * MIN}:{25 * MIN}"] and r.cost == 25 and r.job_id == "job-7-0"
    t = plans.translated(spark.createDataFrame([(1, " x "), (2, None)], "k int, text string"), "k", stub("t ")).collect()
    assert {r.k: (r.result, r.usage_amount) for r in t} == {1: ("t x", 1), 2: ("", 1)}


def test_quotas_of_one_asset_and_variant(spark):
    """Another variant's quota does not count; two rows of one fail; the raising form says what is missing."""
    rows = [("a", "coin", "ocr", 1.0, False), ("a", "coin", "other", 99.0, False), ("b", "coin", "other", 99.0, True)]
    quotas = spark.createDataFrame(rows, "user_id string, asset string, variant string, quota double, is_unlimited boolean")
    owed = spark.createDataFrame([("a", 5, "ocr"), ("b", 1, "ocr"), ("a", 7, "direct")], "user_id string, pages int, route string")
    gated = billing.gate(owed, quotas, "user_id", F.col("pages"), "coin", "ocr", F.col("route") == "direct")
    assert sorted((r.user_id, r.pages, r.allowed) for r in gated.collect()) == [("a", 5, False), ("a", 7, True), ("b", 1, False)]
    with pytest.raises(Exception, match="more than one quota"):
        billing.gate(owed, quotas, "user_id", F.col("pages"), "coin").collect()
    with pytest.raises(Exception, match="You have only 1.0 coins, while you need 5 coins"):
        billing.required(gated.where("user_id = 'a'"), F.col("pages")).collect()


def test_subtitles_need_as_many_timings_as_sentences(spark):
    kinds = "t array<array<double>>, s array<string>"
    srt = transcripts.subtitles_of_arrays(F.col("t"), F.col("s")).alias("srt")
    rows = [([[0.0, 1.5], [86400.25, 90000.0]], ["a", "b"]), ([], []), (None, None)]
    got = [r.srt for r in spark.createDataFrame(rows, kinds).select(srt).collect()]
    assert got == ["1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:00:00,250 --> 01:00:00,000\nb\n", "", ""]
    for bad in [([[0.0, 1.0]], []), (None, ["a"])]:
        with pytest.raises(Exception, match="differ in number"):
            spark.createDataFrame([bad], kinds).select(srt).collect()


def test_pages_by_type(spark):
    from paperloom.functions import mime

    rows = [(1, mime.PDF, b"2"), (2, mime.PDF, b"x"), (3, "image/png", b"p"), (4, "image/jpeg", b"j"), (5, "text/plain", b"t"), (6, None, b"n"), (7, mime.PDF, b"0")]
    df = spark.createDataFrame(rows, "k int, mime string, content binary")
    found = pages.prepare_pages(df, "k", lambda: lambda d: [d] * int(d), lambda: lambda d: d.upper())
    got = sorted((r.k, r.page_no, None if r.content is None else bytes(r.content), r.error) for r in found.collect())
    assert got[:2] == [(1, 0, b"2", None), (1, 1, b"2", None)] and got[2][2] is None and "invalid literal" in got[2][3] and got[3:] == [(3, 0, b"P", None), (4, 0, b"j", None)]


def test_languages_of_sentences_sort_tokens_once(spark):
    """Against a plain loop, with nulls; no join of the tokens with themselves."""
    import random

    r = random.Random(5)
    rows = [(r.choice([1, 2, 3, None]), k, r.choice(["a", "b", ".", "!"]), r.choice(["de", "en", "fr", None])) for k in range(400)]
    t = spark.createDataFrame(rows, "task int, seq long, content string, language string").withColumn("type", F.when(F.col("content").isin(".", "!"), "punctuation").otherwise("word"))
    expected, state = {}, {}
    for task, _, content, language in rows:
        total, open_ = state.setdefault(task, ({}, {}))
        open_[language] = open_.get(language, 0) + 1
        if content in ".!":
            for x, n in open_.items():
                total[x] = total.get(x, 0) + n
            open_.clear()
            known = {x: n for x, n in total.items() if x is not None}
            number = sum(1 for k in expected if k[0] == task)
            expected[task, number] = min(known, key=lambda x: (-known[x], x)) if known else None
    cumulative = transcripts.sentence_languages(t, "task", True)
    assert {(x.task, x.sentence_no): x.language for x in cumulative.collect()} == {k: v for k, v in expected.items() if k[0] is not None and v is not None}
    plan = cumulative._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
