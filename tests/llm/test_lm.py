import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import lm
from tests.llm.conftest import prose, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def brute(rows):
    """(doc_id, held out, tokens, known, base score, score) by dictionaries of n-grams, backing off by recursion."""
    texts = [(i, words((t or "").translate(LOWER)) + [END], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in rows]
    seen = Counter()
    for _, w, out in texts:
        if not out:
            seen.update((x,) for x in w)
            seen.update(zip([END] + w, w))
            seen.update(zip([END] + w, w, w[1:]))
    one = Counter({k[0]: n for k, n in seen.items() if len(k) == 1})
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)

    def p(context, word):
        if not context:
            return ((one[word] - d) if one[word] else d * v) / n
        weight, power = lm.SMOOTHING[len(context) - 1]
        c = seen[context]
        m = weight * c**power + 1
        return (seen[*context, word] + m * p(context[1:], word)) / (c + m)

    result = []
    for i, w, out in texts:
        score = sum(math.log10(p(tuple(([END] + w)[max(0, k - 1) : k + 1]), x)) for k, x in enumerate(w))
        result.append((i, out, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), score))
    return sorted(result, key=str)


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    for g, e in zip(got, brute(rows), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5]) and g[6] == pytest.approx(e[6])
    return got


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "range_bytes": 5000}])
def test_edge_rows(edge, edge_rows, sizes):
    check(lm.lm_scores(edge, **sizes), [r[:2] for r in edge_rows])


def test_whole_table_in_blocks_and_held_out_gain(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(lm.lm_scores(df, 60_000, 90_000), [(r.doc_id, r.text) for r in df.collect()])
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def small_automaton():
    texts = pa.array(["a b a c", "b a d", "a a", "b a c"], pa.large_string())
    probe = [f"{before}{w}" for before in ("", "a ", "b a ", "a b ", "zz ", "zz a ", "c d ") for w in ["a", "b", "c", "d", "unknown", ""]]
    t = lm.tokens_of(pa.concat_arrays([texts, pa.array(probe, pa.large_string())]), 60)
    training = np.arange(len(t.sizes)) < len(texts)
    words, pairs, triples = lm.training_counts(t, training)
    totals = lm.Totals(int((words > 0).sum()), int(words.sum()), int((words == 1).sum()), int((words == 2).sum()))
    return lm.Automaton(t, words, pairs, triples, totals), t, probe, len(texts)


def test_every_state_sums_to_one():
    """After each context: the four words, the end and one unknown word."""
    machine, t, probe, skip = small_automaton()
    logs = machine.traverse(t.sizes, t.word_of)
    ends = np.cumsum(t.sizes)
    for low in range(0, len(probe), 6):
        total = sum(10 ** logs[ends[skip + k] - (1 if k % 6 == 5 else 2)] for k in range(low, low + 6))
        assert total == pytest.approx(1)


def test_states_and_failure_arcs():
    """Arcs, failures and states one by one: a seen triple takes no failure arc, an unseen one up to two."""
    machine, t, probe, skip = small_automaton()
    name = {w: int(np.flatnonzero(t.words == lm.tokens_of(pa.array([w], pa.large_string()), 60).words[lm.tokens_of(pa.array([w], pa.large_string()), 60).word_of[0]])[0]) for w in "abcd"}
    state = np.array([machine.start])
    for w in "ba":
        state, _ = machine.step(state, np.array([name[w]]))
    assert state[0] > len(t.words) and machine.failure[state[0]] == 1 + name["a"] and machine.failure[1 + name["a"]] == 0
    after, log = machine.step(state, np.array([name["c"]]))  # "b a c" was seen, so was "a c"
    assert after[0] > len(t.words) and machine.failure[after[0]] == 1 + name["c"]
    key = state[0] * machine.n_labels + name["c"]
    assert log[0] == machine.arc_log[np.searchsorted(machine.keys, key)]
    after, log = machine.step(state, np.array([name["b"]]))  # "b a b" was not, "a b" was: one failure arc
    key = (1 + name["a"]) * machine.n_labels + name["b"]
    assert log[0] == pytest.approx(machine.failure_log[state[0]] + machine.arc_log[np.searchsorted(machine.keys, key)])
    state, _ = machine.step(state, np.array([name["d"]]))
    after, log = machine.step(state, np.array([name["b"]]))  # neither: two, to the root
    assert after[0] == 1 + name["b"] and log[0] == pytest.approx(machine.failure_log[state[0]] + machine.failure_log[1 + name["d"]] + machine.arc_log[name["b"]])


def test_stretches_of_long_texts_give_what_one_stretch_gives(monkeypatch):
    t = lm.tokens_of(pa.array([prose(60, 3000), "a b", prose(60, 700)], pa.large_string()), 60)
    words, pairs, triples = lm.training_counts(t, np.array([True, False, False]))
    machine = lm.Automaton(t, words, pairs, triples, lm.Totals(int((words > 0).sum()), int(words.sum()), 5, 3))
    whole = machine.traverse(t.sizes, t.word_of)
    monkeypatch.setattr(lm, "STRETCH", 7)
    assert np.allclose(whole, machine.traverse(t.sizes, t.word_of))


def test_copies_stay_in_bounded_blocks(spark):
    """Ten thousand equal rows, ids null: blocks are cut by size alone."""
    from paperloom.llm import block_counts as bc

    df = spark.createDataFrame([(None, prose(61, 40))], "doc_id long, text string").crossJoin(spark.range(10_000)).select("doc_id", "text").repartition(2)
    sizes = [bc.open_block(r.rows)["text"].nbytes for r in bc.pack_blocks(df, 100_000).collect()]
    assert max(sizes) < 220_000 and len(sizes) > 10


def test_no_training_and_no_rows(spark, empty):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0)
    assert lm.lm_scores(empty).count() == 0


def test_counts_through_two_levels_give_the_same_scores(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = {"block_bytes": 20_000, "range_bytes": 9_000}
    one, two = (sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm.lm_scores(documents, **more, most_ranges=n).collect()) for n in (10**6, 5))
    assert one == two
