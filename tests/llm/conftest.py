import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, bands string, score double, kept string, rate string, copies string, `group` string, piece string, n_words string, `range` string, tail string, digest string, block string, runs string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    parts = ["the", "of", "and", "an", "er", "ou", "th", "re", "ion", "é", "sch", "la", "os", "ing"]
    out = []
    for k in range(n):
        out.append("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + (".\n" if k % 17 == 16 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white texts, short and very long ones, copies, near copies, shared passages, repeated rows."""
    a, long = prose(1, 200), prose(2, 12_000)
    near = a.split(" ")
    near[100] = "changed"
    passage = prose(3, 70)
    texts = {
        0: a,
        1: a,
        2: " ".join(near),
        3: None,
        4: "",
        5: " \t\n\x0b ",
        6: "one",
        7: "two words",
        8: "one",
        9: long,
        10: prose(4, 60) + " " + passage + " " + prose(5, 60),
        11: prose(6, 40) + "\n" + passage + " " + prose(7, 90),
        12: passage,
        13: "x " * 300,
        14: "ñandú ÀÉÎ 日本語 😀 x",
        15: prose(8, 49),
        16: prose(8, 50),
        17: prose(8, 50),
        18: prose(8, 51),
        19: "a b c d\x1fe f\x85g",
        25: prose(9, 30),
    }
    rows = [(i, t, ["en", "fr", "de", "es"][i % 4], f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    rows.append((None, prose(10, 80), "en", None, None))
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    rows = [(*r, 7, "k", "b", 0.5, "kept", "rate", "copies", "group", "piece", "n", "range", "tail", "digest", "block", "runs") for r in edge_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
