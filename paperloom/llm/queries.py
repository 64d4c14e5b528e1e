"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import collocations, extraction, fingerprints, licenses, lm, mixing, ngram_join, packing, pii, quality, spelling, substrings, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact, over all pairs that share a shingle; the operator finds a pair at the threshold with a probability of 0.9999.
OP2_SQL = r"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingles AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM docs WHERE len(w) > 0)),
  sets AS MATERIALIZED (SELECT id, doc_id, coalesce(n, 0) AS n, coalesce(name, '') AS name FROM docs LEFT JOIN (SELECT id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM shingles GROUP BY id) USING (id)),
  common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b FROM common JOIN sets x ON x.id = a JOIN sets y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) UNION ALL SELECT x.id, y.id FROM sets x JOIN sets y ON x.n = 0 AND y.n = 0 AND x.id < y.id),
  each_way AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reached(a, b) AS (SELECT id, id FROM docs UNION SELECT r.a, l.b FROM reached r JOIN each_way l ON l.a = r.b),
  classes AS (SELECT r.a AS id, min(s.doc_id) AS class_id FROM reached r JOIN sets s ON s.id = r.b GROUP BY r.a),
  copies AS (SELECT name, min(doc_id) AS copy_id, count(*) AS n_copies FROM sets GROUP BY name)
SELECT doc_id, class_id, (SELECT count(*) FROM each_way l WHERE l.a = sets.id) AS n_links, copy_id, n_copies FROM sets JOIN classes USING (id) JOIN copies USING (name)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  places AS MATERIALIZED (SELECT id, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS window_name FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM docs)),
  least AS (SELECT window_name, min(doc_id) AS least FROM places WHERE window_name IS NOT NULL GROUP BY window_name),
  judged AS (SELECT id, i, word, max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM places LEFT JOIN least USING (window_name)),
  kept AS (SELECT id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM judged GROUP BY id)
SELECT doc_id, len(w) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (id)
"""


#: Wanted shares of tokens by the kind of document that the labels tell of a part of the documents.
KIND_TARGETS = {"clean": 0.85, "toxic": 0.075, "junk": 0.075}


def labelled_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and domain of the labelled documents: junk (quality 0), toxic, or clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mixing_rates(documents, labelled_kinds(spark, sf_dir), KIND_TARGETS)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting spark.paperloom.tokenCache names a cache that runs share; without it, a run has a new one."""
    path = tokenizer_path("piece_bpe_32k.model")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.token_counts(documents, token_counts.sentencepiece_counter(path), token_counts.file_version(path), spark.conf.get("spark.paperloom.tokenCache", None))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(documents, labels, largest_block=9 << 20)  # larger blocks exchange less and need more memory


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(documents, packing.byte_bpe_encoder(tokenizer_path("byte_bpe_50k.json")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BASE_ROWS = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.BASE.items())
_TEMPLATE_ROWS = ", ".join(f"('{label}', {words}, {need})" for label, words, need in licenses.template_sets(licenses.TEMPLATES, licenses.THRESHOLD))
OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  starts AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
  places AS (SELECT id, i - 1 AS start, label FROM starts, (VALUES {_BASE_ROWS}) b(p, label) WHERE w[i:i + len(p) - 1] = p),
  base AS (SELECT id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(label) AS stated FROM places GROUP BY id),
  blocks AS (SELECT id, w[s + 1:s + {licenses.BLOCK_WORDS}] AS block FROM (SELECT id, w, unnest(range(0, greatest(1, len(w) - {licenses.BLOCK_WORDS // 2}), {licenses.BLOCK_WORDS // 2})) AS s FROM docs)),
  pairs AS (SELECT id, label, len(list_intersect(words, block)) AS common, len(words) AS n, need FROM blocks, (VALUES {_TEMPLATE_ROWS}) t(label, words, need)),
  method AS (SELECT id, max(common / n) AS score, list(label) AS found FROM pairs WHERE common >= need GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(stated)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(stated, found))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (id) LEFT JOIN method USING (id)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  parts AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parts),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
  f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
  sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
  candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
  inner_phrases AS (SELECT c.lang, c.a, array_to_string(c.w[i:i + m - 1], ' ') AS phrase FROM candidates c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < c.k AND i + m - 1 <= c.k),
  free AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inner_phrases p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)),
  cuts AS (SELECT c.lang, c.phrase, c.a, j.k, x.f AS l, y.f AS r, s.n, (1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS score FROM free c, range(1, 5) j(k), f x, f y, sizes s
    WHERE j.k < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j.k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j.k + 1:], ' ') AND s.lang = c.lang),
  weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score FROM weakest QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op12_license_scan": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
