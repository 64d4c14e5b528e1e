import hashlib

import numpy as np
import xxhash

from paperloom.llm import fingerprints as fp
from tests.llm.conftest import prose


def sketch(*texts):
    return fp.sketches(*fp._joined([t.encode() for t in texts]))


def test_equal_texts_have_equal_fingerprints_whatever_stands_beside_them():
    a = prose(1, 300)
    alone, beside = sketch(a)[0], sketch("x", a, "", a + "y", a)
    assert (beside[1] == alone).all() and (beside[4] == alone).all()
    assert fp.likeness(beside[2:3], sketch(""))[0] == 1 and fp.likeness(beside[2:3], beside[1:2])[0] == 0


def test_phrases_inside_do_not_depend_on_the_offset():
    a = prose(2, 2000)
    for shift in ("", "q", "some words before ", "zz" * 7):
        names, text = fp._NAMES[np.frombuffer((shift + a).encode(), dtype=np.uint8)], None
        text = np.zeros(len(names), dtype=int)
        for _ in range(3):
            names, text = fp.next_level(names, text)
        if not shift:
            inside = set(names.tolist())
            continue
        assert len(inside & set(names.tolist())) >= 0.97 * len(inside)


def test_runs_of_one_character():
    assert fp.likeness(sketch("a" * 1000), sketch("a" * 1000))[0] == 1
    assert fp.likeness(sketch("a" * 1000), sketch("b" * 1000))[0] < 0.2


def test_likeness_follows_the_edit():
    a, b = prose(3, 1500), prose(4, 1500)
    near = [fp.likeness(sketch(a), sketch(a[: int(len(a) * k)] + b[int(len(a) * k) :]))[0] for k in (1, 0.9, 0.75, 0.5, 0)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] > near[4] and near[4] < 0.1


def text_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_ranges_stay_even_on_skewed_ids(spark):
    """One id far away, half of the ids null, a third of the rows equal: no range is much larger than asked."""
    import itertools

    rows = [(k, f"text {k}") for k in range(6000)] + [(1 << 60, "far")] + [(None, f"other {k}") for k in range(3000)] + [(None, "the same")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = fp.in_order(df)
    bounds = fp.range_bounds(ordered, 500)
    keys = ordered.select("rank", "hash", "row").toArrow()
    place = np.searchsorted(bounds, fp._keys(*(c.to_numpy() for c in keys.columns)), side="right")
    assert len(bounds) >= 20 and np.bincount(place).max() < 1100
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.edited_sha256) for r in fp.edited_fingerprints(df, range_rows=500).collect()))
    order = sorted((i is not None, i or 0, text_hash(t), t) for i, t in rows)
    expected = []
    for (known, i, _, a), (_, _, _, b) in itertools.pairwise([*order, order[0]]):
        n = len(a) // 4
        expected.append((known, i, hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()))
    assert got == sorted(expected)


def plain_level(names):
    """One level of parsing by plain loops over one text's names, from the definition in the docstring."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    step, runs = 0x9E3779B97F4A7C15, []
    for name, group in __import__("itertools").groupby(names):
        n = len(list(group))
        runs.append(mixed((name + n * step) & mask) if n > 1 else name)
    labels = [runs[0] & 1]
    for left, own in zip(runs, runs[1:]):
        bit = ((left ^ own) & -(left ^ own)).bit_length() - 1
        labels.append(2 * bit + (own >> bit & 1))
    for _ in range(2):
        shorter = [labels[0] & 1]
        for left, own in zip(labels, labels[1:]):
            bit = ((left ^ own) & -(left ^ own)).bit_length() - 1 if left != own else 8
            shorter.append(2 * bit + (own >> bit & 1))
        labels = shorter
    phrases, held = [], []
    for k, name in enumerate(runs):
        held.append(name)
        inner = 0 < k < len(runs) - 1
        if k == len(runs) - 1 or (inner and labels[k] > labels[k - 1] and labels[k] >= labels[k + 1]):
            phrases.append(mixed(sum(mixed((x + (j + 1) * step) & mask) for j, x in enumerate(held)) & mask))
            held = []
    return phrases


def test_parsing_against_plain_loops_on_the_whole_table(spark, sf_dir):
    """Every text's fingerprint from a parser of plain loops; long texts of the table included."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    first = [int(x) for x in fp._NAMES]
    checked = 0
    for r in df.collect():
        data = (r.text or "").encode()
        if len(data) > 6000 and r.doc_id % 10:
            continue
        names, out = [first[b] for b in data], [None] * fp.SLOTS
        for level in range(1, max(fp.LEVELS) + 1):
            names = plain_level(names)
            if level in fp.LEVELS:
                for h in fp.mix(np.array(names, dtype=np.uint64)).tolist():
                    slot, value = h >> 58, h & 0xFFFFFFFF
                    out[slot] = value if out[slot] is None else min(out[slot], value)
        full = [k for k in range(fp.SLOTS) if out[k] is not None]
        own = got[r.doc_id]
        assert all(int(own[4 * k : 4 * k + 4], 16) == (out[k] >> 16 | 1) for k in full)
        checked += 1
    assert checked >= 150


def test_against_a_plain_loop(spark, edge):
    """Every row's edited text, over ranges small and large; a null id comes first, repeated ids in turn."""
    for rows_each in (4000, 3):
        got = fp.edited_fingerprints(edge, range_rows=rows_each).toPandas()
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, text_hash(r["text"] or ""), r["text"] or "") for r in edge.collect()))
        expected = []
        for k, (known, doc_id, _, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][3]
            n = len(text) // 4
            edited = text[: len(text) - n] + after[:n]
            near = float(fp.likeness(sketch(text), sketch(edited))[0]), float(fp.likeness(sketch(text), sketch(after))[0])
            expected.append((doc_id if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
        found = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got.itertuples()]
        assert sorted(map(str, found)) == sorted(map(str, expected))
        by_text = dict(zip(got["doc_id"], got["fingerprint"]))
        assert by_text[0] == by_text[1] and by_text[3] == by_text[4]


def test_lone_and_no_documents(spark, empty):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fp.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
    assert fp.edited_fingerprints(empty).count() == 0 and fp.fingerprints(one).first().fingerprint == r.fingerprint
