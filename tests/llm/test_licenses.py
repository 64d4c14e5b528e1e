import math
import random
import re

import duckdb
import pytest

from paperloom.llm import licenses as li
from paperloom.llm import queries
from tests.llm.conftest import prose

LOWER = str.maketrans(li.UPPER, li.LOWER)
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT = li.TEMPLATES[6][1]


def brute(rows, templates=None, threshold=0.8, block_words=64):
    out = []
    for i, text in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places = [(k, label) for p, label in li.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels, score = {x for _, x in places}, 1.0 if places else 0.0
        step = block_words // 2
        for s in range(0, max(1, len(w) - step), step):
            block = set(w[s : s + block_words])
            for label, t in templates or li.TEMPLATES:
                t = set(t.split())
                if len(t & block) >= max(1, math.ceil(round(threshold * len(t), 9))):
                    labels.add(label)
                    score = max(score, len(t & block) / len(t))
        starts = [k for k, _ in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=str)


def test_whole_table(spark, sf_dir):
    for size in ("sf0.001", "sf0.01"):
        folder = sf_dir.replace("sf0.001", size)
        expected = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
        assert found(queries.op12_license_scan(spark, folder)) == expected
        assert len({e[6] for e in expected}) > 3
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP12_SQL})").fetchall(), key=str) == expected


def test_edge_rows(edge, edge_rows):
    assert found(li.license_scan(edge)) == brute([(r[0], r[1]) for r in edge_rows])


def notice(r, text, lost, added):
    """A notice with some words lost, others in between and in another order, and its lines wrapped."""
    w = text.split()
    for _ in range(lost):
        w.pop(r.randrange(len(w)))
    for _ in range(added):
        w.insert(r.randrange(len(w) + 1), prose(r.random(), 1))
    if r.random() < 0.3:
        r.shuffle(w)
    return "\n// ".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))


def test_changed_notices_at_every_place(spark):
    r = random.Random(4)
    rows = []
    for k in range(160):
        label, text = r.choice(li.TEMPLATES)
        parts = [prose(k, r.randint(0, 150)), notice(r, text.upper() if k % 5 == 0 else text, r.randint(0, 7), r.randint(0, 40)), prose(-k, r.randint(0, 90))]
        rows.append((k, " ".join(parts)))
    expected = brute(rows)
    df = spark.createDataFrame([(*x, "n", 3) for x in rows], "doc_id long, text string, digest string, n_words long").repartition(3)
    assert found(li.license_scan(df)) == expected
    assert 40 < sum(e[6] != "" for e in expected) < 150
    for threshold in (0.5, 1.0):
        assert found(li.license_scan(df, threshold=threshold, block_words=70)) == brute(rows, threshold=threshold, block_words=70)


def test_phrases_ties_nulls_and_repeated_ids(spark):
    rows = [
        (1, "Under the MIT License, under\tthe (mit) LICENSE; Apache License, Version 2.0. CC BY-NC 4.0 cc by nc"),
        (1, "Under the MIT License, under\tthe (mit) LICENSE; Apache License, Version 2.0. CC BY-NC 4.0 cc by nc"),
        (1, MIT),
        (None, MIT),
        (None, None),
        (2, ""),
        (3, "xunder the mit license under the mit licenseé cc by ncx"),
        (4, "under the mit licenſe CC BY NC \U0001d4d0cc by nc cc by nc\U0001d4d0"),
        (5, MIT + " " + prose(1, 30) + " " + li.TEMPLATES[3][1]),
        (6, " ".join([prose(2, 20_000), MIT, prose(3, 20_000), "under the mit license"])),
    ]
    expected = brute(rows)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, label string")
    assert found(li.license_scan(df)) == expected
    assert [e[2] for e in expected if e[5]] and {e[6] for e in expected} >= {"apache-2,cc-by-nc,mit", "mit", "gpl,mit", ""}


def test_no_python_on_the_way(edge):
    plan = li.license_scan(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_templates_of_other_lengths(spark, empty):
    assert li.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        li.license_scan(empty, block_words=40)
    rows = [(1, "one two three"), (2, "three two"), (3, "two")]
    templates = [("a", "one"), ("b", "one two three two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(li.license_scan(df, templates=templates, threshold=0.6, block_words=10)) == brute(rows, templates, 0.6, 10)
