import corpus_pipeline as cp
from paperloom.llm import packing, pii
from paperloom.llm.queries import tokenizer_path
from tests.llm.conftest import prose
from tests.llm.test_ngram_join import brute


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage on the whole of what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before_df = docs
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        before, after = docs.collect(), out.collect()
        kept[name] = after
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            assert {r.doc_id for r in after} < {r.doc_id for r in before} and {tuple(r) for r in after} <= {tuple(r) for r in before}
        elif name == "near_duplicates":
            expected = {c for _, c, _, _ in brute([(r.doc_id, r.text) for r in before])}
            assert sorted(r.doc_id for r in after) == sorted(expected)
        elif name == "personal_data":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            assert not any(pii.base_spans(r.text) for r in after) and all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing":
            assert {tuple(r) for r in after} == {tuple(r) for r in before} and len(after) >= len(before)
        elif name == "packing":
            copies = {}
            for r in before:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            pieces = {}
            for r in after:
                pieces[r.doc_id, r.piece] = pieces.get((r.doc_id, r.piece), 0) + 1
            assert {i for i, _ in pieces} == set(copies) and all(n == copies[i] for (i, _), n in pieces.items())
            sequences = {}
            for r in after:
                sequences.setdefault(r.sequence_id, []).append(r.length)
            limits = cp.PACKING_LIMITS
            assert all(sum(x) <= 2048 and len(x) <= limits["max_documents"] and (len(x) == 1 or sum(n * n for n in x) <= limits["max_attention"]) for x in sequences.values())
            # both limits bind: some sequences stop at either, and more are needed than for tokens alone
            free = packing.pack_documents(before_df, packing.byte_bpe_encoder(tokenizer_path("byte_bpe_50k.json"))).select("sequence_id").distinct().count()
            assert free <= len(sequences) <= 1.5 * free
        docs = out


def test_null_and_repeated_ids_are_deduplicated(spark, sf_dir):
    """Copies among rows without ids or of one id go too; of rows that tie the least stays, whatever their order."""
    a, b = prose(70, 120), prose(71, 120)
    near = a.split(" ")
    near[3] = "other"
    rows = [(None, a, "en", "s", 1), (5, " ".join(near), "en", "s", 1), (None, b, "fr", "t", 1), (None, b, "fr", "s", 1), (7, prose(72, 90), "en", "s", 1), (7, a, "en", "s", 1), (7, prose(73, 90), "es", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    expected = sorted([rows[1], rows[3], rows[4], rows[6]], key=str)
    for order in (rows, rows[::-1]):
        got = cp.near_duplicate_stage(spark, spark.createDataFrame(order, schema).repartition(2), sf_dir)
        assert sorted(map(tuple, got.collect()), key=str) == expected


def test_edge_rows(spark, edge, sf_dir, tmp_path):
    docs = edge
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert docs.count() > 0


def test_empty_table(spark, empty, sf_dir):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
