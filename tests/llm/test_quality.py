import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality as q
from tests.llm.conftest import prose, words

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_of_edge_rows(spark, edge, edge_rows):
    extra = [(100, "a b\nc\n\n a\na b\nc\r\nc\n#*$%&|<> é#", None, None, None), (101, " ".join("abcdefgh") + " x " + " ".join("abcdefgh") + prose(5, 20), None, None, None)]
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    got = q.quality_rules(df, spark.createDataFrame([(0, 1, 0)], LABELS)).collect()
    rows = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)
    assert rows == sorted(((r[0], *base(r[1])) for r in edge_rows + extra), key=str)
    assert all(r.kept == (not r.base_failed and r.score >= q.THRESHOLD) for r in got)


def test_scores_against_a_plain_count(spark, sf_dir):
    """The whole table, by the buckets of each text alone."""
    import pyarrow as pa

    from paperloom.llm.words import blocks

    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    each = {r.doc_id: Counter(q.ngram_buckets(next(blocks(pa.array([r.text])))[2], 60)[0].tolist()) for r in documents.collect()}
    raw, target = Counter(), Counter()
    for i, c in each.items():
        raw.update(c)
        if i in good:
            target.update(c)
    scale = sum(raw.values()) / sum(target.values())
    for r in q.quality_rules(documents, labels, spare_bits=40).collect():
        c = each[r.doc_id]
        expected = sum(n * math.log((target[b] * scale + q.PRIOR) / (raw[b] + q.PRIOR)) for b, n in c.items()) / max(sum(c.values()), 1)
        assert r.score == pytest.approx(expected, abs=1e-9)


def test_scores_against_plain_words_and_pairs(spark, sf_dir):
    """The whole table, by words and pairs of words as they are, with nothing of the operator's hashing."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    each = {r.doc_id: Counter([*(w := words(r.text)), *zip(w, w[1:])]) for r in documents.collect()}
    raw, target = sum(each.values(), Counter()), sum((c for i, c in each.items() if i in good), Counter())
    scale = raw.total() / target.total()
    for r in q.quality_rules(documents, labels, spare_bits=40).collect():
        c = each[r.doc_id]
        expected = sum(n * math.log((target[g] * scale + q.PRIOR) / (raw[g] + q.PRIOR)) for g, n in c.items()) / max(c.total(), 1)
        assert r.score == pytest.approx(expected, abs=1e-9)
        assert r.kept == (not r.base_failed and expected >= q.THRESHOLD)


def test_labelled_documents(spark, sf_dir):
    """Good documents are kept, junk goes; on the middle table, which has 58 junk documents."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = q.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.1


def test_kept_columns_replace_measures_of_their_names(spark, edge, edge_rows):
    out = q.quality_rules(edge, spark.createDataFrame([], LABELS), keep=edge.columns)
    assert out.columns.count("score") == 1 and out.count() == len(edge_rows) and {r.score for r in out.collect()} == {0.0}


def test_empty_table(spark, empty):
    assert q.quality_rules(empty, spark.createDataFrame([(1, 1, None)], LABELS)).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_labelled_junk_goes_whatever_the_size(spark, sf_dir, size):
    """Of junk that the base rule leaves none is kept, of good documents and of unlabelled ones as many on each table."""
    folder = sf_dir.replace("sf0.001", size)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic")
    got = q.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("NOT base_failed").join(labels, "doc_id", "left")
    shares = {r.quality: (r.n, r.kept) for r in got.groupBy("quality").agg(F.count("*"), F.count_if("kept")).toDF("quality", "n", "kept").collect()}
    assert shares[0][0] >= 28 and shares[0][1] == 0
    assert shares[1][1] >= 0.98 * shares[1][0] and shares[None][1] >= 0.88 * shares[None][0]


def test_small_blocks_and_wider_keys_give_the_same_scores(spark, edge):
    labels = spark.createDataFrame([(0, 1, 0), (11, 1, None)], LABELS)
    one, many = (sorted(((r.doc_id, r.n_words, round(r.score, 9)) for r in q.quality_rules(edge, labels, **more).collect()), key=str) for more in ({}, {"block_bytes": 700, "spare_bits": 40}))
    assert one == many


def test_toxic_text_of_good_form_is_not_caught(spark, sf_dir):
    """Records the method's reach: 40 of 40 such documents are kept."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    toxic = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 AND toxic = 1").select("doc_id")
    got = q.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).join(toxic, "doc_id").where("NOT base_failed").collect()
    assert len(got) == 40 and sum(r.kept for r in got) == 40 and "toxic text of good form" in q.__doc__


def test_trusted_documents_are_bounded(spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)] * 2 + [(99, 1, 1), (None, 1, 0), (98, 0, 0)], LABELS)
    assert q.trusted_ids(labels).tolist() == list(range(50))
    few = q.trusted_ids(labels, most=7)
    assert len(set(few)) == 7 and (few == q.trusted_ids(labels.repartition(3), most=7)).all()


def test_counts_through_two_levels_give_the_same_scores(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = {"block_bytes": 20_000, "range_bytes": 9_000}
    one, two = (sorted((r.doc_id, r.n_words, round(r.score, 9), r.kept) for r in q.quality_rules(documents, labels, **more, most_ranges=n).collect()) for n in (10**6, 5))
    assert one == two and any(r[2] for r in one)
