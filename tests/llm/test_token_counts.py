import sentencepiece

from paperloom.llm import token_counts as tc
from paperloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return sorted(((i, len((t or "").encode()), (n := len(model.encode(t or ""))), n > 4096) for i, t in rows), key=str)


def test_edge_rows(edge, edge_rows):
    assert found(tc.token_counts(edge, tc.sentencepiece_counter(PATH), "v1")) == brute([r[:2] for r in edge_rows])


def test_special_strings_are_text(spark):
    rows = [(1, "<s> a </s> <unk> <0x41>"), (2, "▁▁ a　b\x00")]
    assert found(tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tc.sentencepiece_counter(PATH), "v1")) == brute(rows)


def test_only_distinct_misses_are_encoded_and_appended(spark, edge, edge_rows, tmp_path):
    cache = f"file://{tmp_path}/cache"
    calls = spark.sparkContext.accumulator(0)

    def counter():
        def count(texts):
            calls.add(len(texts))
            return [len(t) for t in texts]

        return count

    distinct = len({r[1] or "" for r in edge_rows})
    tc.token_counts(edge, counter, "v1", cache)
    assert spark.read.parquet(cache).count() == distinct and calls.value == distinct
    more = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(99, "new text")], "doc_id long, text string"))
    again = tc.token_counts(more, counter, "v1", cache)
    assert calls.value == distinct + 1 and {r.doc_id: r.n_tokens for r in again.collect()}[99] == 8
    tc.token_counts(edge, counter, "v2", cache)
    assert calls.value == 2 * distinct + 1  # another version shares nothing


def test_empty_table(empty):
    assert tc.token_counts(empty, tc.sentencepiece_counter(PATH), "v1").count() == 0


def test_hot_copies_do_not_meet_in_one_task(spark):
    """A third of all rows are copies: their counts are broadcast, the rest are joined; every row is counted."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    counted = tc.token_counts(rows, lambda: lambda texts: [len(t) for t in texts], "v")
    got = {r.doc_id: r.n_tokens for r in counted.collect()}
    assert got == {i: 13 if i % 3 == 0 else 5 + len(str(i)) for i in range(3000)}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_the_registered_query_uses_a_cache_that_is_named(spark, sf_dir, tmp_path):
    """A second run encodes nothing, and a stored count is what it returns."""
    from pyspark.sql import functions as F

    from paperloom.llm import queries

    cache = f"file://{tmp_path}/cache"
    spark.conf.set("spark.paperloom.tokenCache", cache)
    try:
        first = sorted(map(tuple, queries.op6_token_counts(spark, sf_dir).collect()))
        stored = spark.read.parquet(cache)
        n, other = stored.count(), f"file://{tmp_path}/other"
        assert sorted(map(tuple, queries.op6_token_counts(spark, sf_dir).collect())) == first and spark.read.parquet(cache).count() == n
        stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(other)
        spark.conf.set("spark.paperloom.tokenCache", other)
        assert sorted(r.n_tokens - 1000 for r in queries.op6_token_counts(spark, sf_dir).collect()) == sorted(r[2] for r in first)
    finally:
        spark.conf.unset("spark.paperloom.tokenCache")


def test_whole_table_against_the_library(spark, sf_dir):
    import sentencepiece

    from paperloom.llm import queries

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
