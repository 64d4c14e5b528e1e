import hashlib

import numpy as np
import pytest

from paperloom.llm import fm_index
from paperloom.llm import substrings as sub
from tests.llm.conftest import prose, words


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    keep[k : k + window] = [False] * window
        out.append((i, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep) if y).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot, shard_words", [(sub.HOT, sub.SHARD_WORDS), (1, 300)])
def test_edge_rows(edge, edge_rows, hot, shard_words):
    assert found(sub.substring_dedup(edge, hot=hot, shard_words=shard_words)) == brute([(r[0], r[1]) for r in edge_rows])


def test_passages_within_and_across(spark):
    p = prose(50, 55)
    rows = [(10, p + " end"), (3, "start " + p), (7, f"{p} {p} {prose(51, 20)} {p}"), (8, " ".join(p.split()[:50])), (9, " ".join(p.split()[:49]) + " other"), (2, "a b " * 60), (1, "a b " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(sub.substring_dedup(df)) == brute(rows)


def test_empty_table(empty):
    assert sub.substring_dedup(empty).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(sub.substring_dedup(df, hot=2)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 7, 39, 200):
        assert (sub.sliding_least(x, width) == [x[k : k + width].min() for k in range(len(x) - width + 1)]).all()
    assert len(sub.sliding_least(x, 201)) == 0


def plain_statistics(text, value, query, below, depth):
    """For each place of the query, the longest run of its symbols that stands in the text from a place of a smaller value on."""
    out = []
    for k in range(len(query)):
        best = 0
        for p in range(len(text)):
            if value[p] < below:
                n = 0
                while n < depth and k + n < len(query) and p + n < len(text) and text[p + n] == query[k + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("depth", [1, 3, 8, 50])
def test_statistics_against_plain_search(depth):
    """Texts that are indexed and texts that are not, with symbols that the index lacks, and matches that shrink and grow again."""
    r = np.random.default_rng(depth)
    texts = [r.integers(1, 4, n) for n in (60, 17, 9, 40, 8, 3)] + [np.tile([1, 2, 3], 20)]
    sizes = np.array([len(t) for t in texts])
    text, value = np.concatenate([np.append(t, 0) for t in texts]), np.repeat(np.arange(len(texts)), sizes + 1)
    index = fm_index.FMIndex(text, 4, depth, value.astype(np.int32))
    queries = sorted([*texts, r.integers(1, 6, 80), np.tile([3, 1, 2], 25), texts[0][5:50], np.array([7, 1]), np.array([], dtype=np.int64)], key=len, reverse=True)
    bounds = r.integers(0, len(texts) + 1, len(queries))
    starts = np.cumsum([len(q) for q in queries]) - [len(q) for q in queries]
    found = index.statistics(np.concatenate(queries), starts, np.array([len(q) for q in queries]), bounds)
    for q, s, below in zip(queries, starts, bounds):
        assert found[s : s + len(q)].tolist() == plain_statistics(text, value, q, below, depth)


def test_minima():
    x = np.random.default_rng(4).integers(0, 9, 77)
    m = fm_index.Minima(x)
    pairs = np.array([(a, b) for a in range(77) for b in range(a + 1, 78)])
    assert (m.least(pairs[:, 0], pairs[:, 1]) == [x[a:b].min() for a, b in pairs]).all()
    for floor in range(10):
        at, f = np.arange(77), np.full(77, floor)
        assert m.run_before(at, f).tolist() == [next((k + 1 for k in range(p, -1, -1) if x[k] < floor), 0) for p in at]
        assert m.run_behind(at, f).tolist() == [next((k for k in range(p, 77) if x[k] < floor), 77) for p in at]


def test_rows_of_one_id(spark):
    """Different texts under one id lose their own words only."""
    p, other = prose(60, 70), prose(61, 90)
    rows = [(3, p), (7, p), (7, other), (7, other), (7, other + " " + p), (9, other), (3, "short"), (None, p), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (sub.HOT, 1):
        assert found(sub.substring_dedup(df, hot=hot)) == brute(rows)


def test_a_passage_of_many_documents(spark):
    passage = prose(70, 60)
    rows = [(k, f"{prose(1000 + k, k % 30)} {passage} {prose(2000 + k, k % 7)}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(sub.substring_dedup(df, hot=50, shard_words=500)) == brute(rows)


def test_wavelet_rank():
    x = np.random.default_rng(3).integers(0, 37, 500)
    w = fm_index.WaveletMatrix(x, 40)
    for c in (0, 5, 36):
        at = np.arange(501)
        assert (w.rank(np.full(501, c), at) == [(x[:k] == c).sum() for k in at]).all()
