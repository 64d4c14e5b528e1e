import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing
from paperloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    encode, r = packing.byte_bpe_encoder(PATH)(), random.Random(1)
    latin, other = [chr(i) for i in range(256)], ["日", "😀", "ſ", " ", "́", "<|endoftext|>", "Ж", "٣", "'ll", "'s"]
    for k in range(4000):
        t = "".join(r.choice(latin + other * (20 if k % 2 else 0)) for _ in range(r.randint(0, 25)))
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def check(rows, packed, library):
    """Every document's pieces have its ids; sequences are filled without gaps up to the capacity."""
    expected = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in packed), key=str) == sorted(expected, key=str)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), sum(r.length for r in packed)


def test_edge_rows(edge, edge_rows, empty, library):
    check([r[:2] for r in edge_rows], packing.pack_documents(edge, packing.byte_bpe_encoder(PATH)).collect(), library)
    assert packing.pack_documents(empty, packing.byte_bpe_encoder(PATH)).count() == 0


def test_whole_table_needs_few_sequences(spark, sf_dir, library):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, tokens = check([(r.doc_id, r.text) for r in df.collect()], packing.pack_documents(df, packing.byte_bpe_encoder(PATH)).collect(), library)
    assert n <= 1.01 * tokens / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds_and_the_rule_decides(rule):
    r = np.random.default_rng(4)
    lengths = r.integers(1, 400, 500)
    capacity, documents, attention = 1000, 6, 250_000
    sequence, offset = packing.best_fit(lengths, capacity, documents, attention, rule)
    scale = np.array([capacity, documents, attention])
    left = {}
    for i in np.argsort(-lengths, kind="stable"):  # the same choices, over every open sequence
        need = np.array([lengths[i], 1, lengths[i] ** 2])
        fits = [(k, v - need, v) for k, v in left.items() if (v >= need).all()]
        if fits:
            worth = [(-(((after / scale) ** 2).sum()) if rule == "norm" else (v / scale) @ (need / scale), -after[0]) for _, after, v in fits]
            best = max(worth)
            assert any(k == sequence[i] and w == pytest.approx(best) for (k, _, _), w in zip(fits, worth))
            left[sequence[i]] = left[sequence[i]] - need
        else:
            assert sequence[i] not in left
            left[sequence[i]] = scale - need
        assert (left[sequence[i]] >= 0).all()
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.concatenate(([0], np.cumsum(lengths[own])[:-1]))).all()


def test_groups(spark):
    rows = [(k, 0, 0, int(x), k) for k, x in enumerate(np.random.default_rng(1).integers(1, 2049, 3000))]
    df = spark.createDataFrame(rows, packing.PIECES).repartition(4)
    got = packing.best_fit_packing(df, group_pieces=500).collect()
    assert len(got) == 3000 and len({r.sequence_id for r in got}) <= 1.05 * sum(r[3] for r in rows) / 2048


def test_ten_thousand_equal_rows_are_dealt_over_groups(spark):
    df = spark.createDataFrame([(None, 0, 0, 100, 7)], packing.PIECES).crossJoin(spark.range(10_000)).drop("id").repartition(3)
    packed = packing.best_fit_packing(df, group_pieces=500).collect()
    groups = [r.sequence_id >> 32 for r in packed]
    assert len(packed) == 10_000 and max(groups.count(g) for g in set(groups)) < 800
    assert len({r.sequence_id for r in packed}) <= 1.05 * 10_000 / 20
