import random

import pytest

from paperloom.llm import ngram_join as nj
from tests.llm.conftest import prose, words


def brute(rows):
    """(doc_id, class_id, n_links, n_copies) over all pairs."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for k, r in enumerate(rows):
        members.setdefault(top(k), []).append(r[0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((r[0], least(members[top(k)]), links[k], sum(s == sets[k] for s in sets)) for k, r in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()), key=str)


def test_edge_rows(edge, edge_rows):
    assert found(nj.ngram_jaccard_join(edge)) == brute([(r[0], r[1]) for r in edge_rows])


def test_empty_table(empty):
    assert nj.ngram_jaccard_join(empty).count() == 0


@pytest.mark.parametrize("block, block_shingles", [(256, 1 << 20), (8, 1 << 20), (256, 900)])
def test_groups_of_near_copies_whole_and_cut_into_parts(spark, block, block_shingles):
    r, rows = random.Random(3), []
    for g in range(4):
        base = prose(100 + g, 150).split(" ")
        for k in range((3, 25, 40, 1)[g]):
            text = base[:]
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = f"w{r.randint(0, 30)}"
            rows.append((1000 * g + k, " ".join(text)))
    rows += [(9000 + k, rows[30][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(nj.ngram_jaccard_join(df, block=block, block_shingles=block_shingles)) == brute(rows)


def test_rows_without_ids_and_of_one_id(spark):
    a, b, c = prose(80, 90), prose(81, 90), prose(82, 90)
    near = a.replace(" ", "  ", 3).rsplit(" ", 1)[0]
    rows = [(None, a), (None, near), (None, b), (None, b), (4, b), (4, c), (4, c), (4, None), (None, ""), (6, c.rsplit(" ", 2)[0]), (None, prose(83, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(nj.ngram_jaccard_join(df)) == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = nj.choose_bands()
    assert bands * rows <= nj.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= nj.RECALL


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(nj.ngram_jaccard_join(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
