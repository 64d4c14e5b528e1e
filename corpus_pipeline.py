"""A corpus pipeline of operators from paperloom.llm, each stage a Parquet table.

quality: documents that the quality rules reject go. near_duplicates: one row of each group of
n-gram Jaccard links stays: of least doc_id (a null id counts as the greatest), and among rows of
equal id the least by text and then by the other columns. personal_data: spans are masked and
n_chars follows. mixing: documents are repeated so that the tokens of clean and of toxic documents,
as predicted from the labels of a part, meet their targets; none is lost. packing: token sequences
of bounded documents and attention cost.

Cases: null, empty and short texts are rejected by the quality stage. Texts are whole at every
length. Repeated rows, and rows with null or repeated ids, are deduplicated like others. Rows that
tie in every column are alike, so which stays makes no difference. Empty tables give no rows. Columns
besides those of documents are kept up to packing and may have any names but those that Spark
itself cannot tell apart. Without labels no document is trusted and rates are 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixing, ngram_join, packing, pii, quality
from paperloom.llm.queries import labelled_kinds, tokenizer_path
from paperloom.llm.shared import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels, keep=docs.columns).where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # every id and text is a document of its own to the join, under a key that is never null; a digest keeps those apart whose keys meet by chance
    id_of, text_of = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(id_of, text_of).alias("key"), F.md5(F.concat_ws(":", id_of, text_of)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    classes = ngram_join.ngram_jaccard_join(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    ids = rows.select("key", F.col("row.doc_id").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "key")
    first = classes.select(F.col("doc_id").alias("key"), "class_id").distinct().join(ids, "key").groupBy("class_id").agg(F.min(order).alias("first"))
    kept = rows.join(first.select("first.key"), "key", "left_semi")
    return kept.groupBy("key", "digest").agg(F.min_by("row", _order(docs)).alias("row")).select("row.*")


def _order(docs: DataFrame) -> Column:
    """An order of whole rows, column by column; those whose type has none go by their JSON."""
    columns = [F.col("row")[f.name] for f in docs.schema]
    return F.struct(*[F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else c for f, c in zip(docs.schema, columns)])


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long"))


#: Wanted shares of tokens; junk has gone by now.
KIND_TARGETS = {"clean": 0.93, "toxic": 0.07}


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, labelled_kinds(spark, sf_dir), KIND_TARGETS)


#: Capacities of a sequence besides its tokens; both bind.
PACKING_LIMITS = {"max_documents": 16, "max_attention": 3 * packing.CAPACITY**2 // 4}


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.byte_bpe_encoder(tokenizer_path("byte_bpe_50k.json")), **PACKING_LIMITS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
