import random
import re
import zlib
from collections import Counter

import pytest

from paperloom.llm import spelling as sp

LOWER = str.maketrans(sp.UPPER, sp.LOWER)


def vocabulary(rows, min_length=7, min_count=2):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def neighbours(w, letters):
    out = {w[:k] + w[k + 1 :] for k in range(len(w))}
    out |= {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
    return out - {w}


def brute(rows, **more):
    counts = vocabulary(rows, **more)
    letters = sorted({c for w in counts for c in w})
    near = {w: [x for x in neighbours(w, letters) if x in counts] for w in counts}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("size, part", [("sf0.001", sp.PART), ("sf0.01", 7)])
def test_whole_table(spark, sf_dir, size, part):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', size)}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert sum(e[4] for e in expected) > 20
    assert found(sp.spelling_variants(df, part=part)) == expected


def test_edge_rows(edge, edge_rows):
    assert found(sp.spelling_variants(edge)) == brute([(r[0], r[1]) for r in edge_rows])


def test_forms_of_forms_ties_accents_and_long_words(spark):
    long = "ab" * 400
    words = ["received"] * 300 + ["recieved"] * 25 + ["recived"] * 30 + ["recivd", "recivdd"] * 2 + ["éclairer"] * 20 + ["Éclairer", "eclairer"] * 2 + ["bananan"] * 40 + ["bananann"] * 40 + ["anananan"] * 2 + ["bananana"] * 3 + [long] * 20 + [long + "x", long[1:]] * 2 + ["aaaaaaa"] * 50 + ["aaaaaaaa"] * 4 + ["aaaaaaaaa"] * 2
    random.Random(1).shuffle(words)
    rows = [(k, " ".join(words[k::5]) + " 1naïveté×x÷") for k in range(5)]
    expected = brute(rows)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n long, word string")
    assert found(sp.spelling_variants(df)) == expected
    assert any(e[1] and e[2] != e[1] for e in expected)


def test_random_words_of_few_letters(spark):
    """Words over three letters repeat their bigrams, so that places and ties matter."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(7, 9))) for _ in range(1500)})
    got = {(p.a, p.b) for p in sp.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), part=50).collect()}
    have = set(words)
    assert got == {(w, x) for w in words for x in neighbours(w, "abc") if x in have and w < x}


def test_empty_table_and_short_words(empty):
    assert sp.spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        sp.spelling_variants(empty, min_length=4)
