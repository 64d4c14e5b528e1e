import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import collocations as co
from paperloom.llm import queries
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute_counts(rows, max_words=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(max_words, len(w) - i) + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    return f, n


def brute(rows, least=100, top=2000):
    out = []
    f, n = brute_counts(rows)
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * counts[p[i : i + m]]}
        ranked = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table(spark, sf_dir):
    for size in ("sf0.001", "sf0.01"):
        folder = sf_dir.replace("sf0.001", size)
        expected = brute([(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()])
        assert found(queries.op13_phrase_collocations(spark, folder)) == expected and len(expected) > 30
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP13_SQL})").fetchall()) == expected


def words_of(*beginnings):
    return [b.split(b" ") for b in beginnings]


@pytest.mark.parametrize("plan", [None, co.Plan(), co.Plan([b"the", b"x", "é".encode()], {"en": words_of(b"x", b"x x", b"x x x", b"the", b"a")})])
def test_edge_rows(edge, edge_rows, plan):
    """Also where beginnings are dealt further that are not frequent, and with blocks of one text."""
    expected = brute([(r[2], r[1]) for r in edge_rows], least=3, top=25)
    assert found(co.collocations(edge, least=3, top=25, plan=plan, block_bytes=1)) == expected and expected


def test_separators_controls_ties_and_nulls(spark):
    texts = ["a b", "A\tb c", "a\x01 b c", "a\x08b\x00 c", "\x00 \x00 d", "a,b a;b:a!b?a.b\na b\x0bc d\re f", "é É ñ", "  a   b  ", "", None, "x x x x x x x x", " a b c"]
    rows = [(lang, t) for t in texts for lang in ("en", None, "und", "fr")] * 3
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, n long, rank long, f long").repartition(5)
    for plan in (None, co.Plan([b"x", b"a"], {"en": words_of(b"a", b"x", b"x x"), "und": words_of(b"a")})):
        assert found(co.collocations(df, least=2, top=7, plan=plan)) == brute(rows, least=2, top=7)


def test_hot_beginnings_share_the_work(spark):
    """A pair that begins a third of all suffixes is dealt by what follows it."""
    rows = [("en", " ".join(f"hot pair w{k * 7 + j} v{j % 5}" for j in range(40))) for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    plan = co.sampled_plan(df, 5)
    code = plan.dictionary.encode
    assert {code([b"hot"]), code([b"hot", b"pair"])} <= plan.hot["en"]
    suffixes = pa.array([code([b"hot", b"pair", b"w%d" % k, b"x"]) for k in range(100)], pa.binary())
    assert len(set(co.deals(suffixes, co._hash_codes(plan.hot["en"]), 5).tolist())) > 90
    assert found(co.collocations(df, least=20, plan=plan)) == brute(rows, least=20)


def test_codes():
    words = [f"w{k}".encode() for k in range(70_000)]
    d = co.Dictionary(words)
    for some in ([b"w0"], [b"w254", b"w255", b"w64769"], [b"w64770", b"\xff\xfe", b"w1"], []):
        assert d.decode(d.encode(some)) == some
    assert len({d.encode([w]) for w in words}) == len(words) and b"\0" not in d.encode(words[:64_770])


def test_counts_past_64_bits(spark):
    df = spark.sql("SELECT 2000000000000L AS a, 30000000000000L AS n, 2000000000001L AS l, 2000000000000L AS r")
    a, n, l, r = (f"cast({c} as decimal(19,0))" for c in "anlr")
    assert df.selectExpr(f"(1000 * ({a} * {n})) div ({l} * {r}) AS s").first().s == 1000 * 2000000000000 * 30000000000000 // (2000000000001 * 2000000000000)


def test_stack_over_small_batches():
    """Counts do not depend on where a batch of sorted suffixes ends."""
    texts = [prose(3, 300), "b a b a b a b a b", "a"]
    d = co.Dictionary([b"a", "é".encode()])
    suffixes = co.Suffixes(pa.array(texts, pa.large_string()), 5, d)
    rows = sorted((s for s in suffixes.strings(0, suffixes.n).to_pylist()), reverse=True)
    results = set()
    for size in (1, 3, 7, 1000):
        stack = co.PhraseStack(5, 2, co._hash_codes(()))
        for k in range(0, len(rows), size):
            part = pa.array(rows[k : k + size], pa.binary())
            stack.read(part, np.ones(len(part), dtype=np.int64))
        stack.end()
        results.add(tuple(sorted(((p and b" ".join(d.decode(p)).decode(), n) for p, n in stack.closed), key=str)))
    f, n = brute_counts([("en", t) for t in texts])
    assert results == {tuple(sorted([(" ".join(p), c) for p, c in f["en"].items() if c >= 2] + [(None, n["en"])], key=str))}


def test_empty_table(empty):
    assert co.collocations(empty).count() == 0
