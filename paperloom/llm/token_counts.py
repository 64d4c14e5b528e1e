"""Token counts: a cache from (digest of the normalised content, tokenizer version) to a stored count.

Contents are normalised (null becomes empty; nothing else, since a tokenizer sees everything
else) and digested. Digests are joined to the cache; only distinct contents that it lacks are
encoded, and their counts are appended to it. A cache is a Parquet folder in storage that all
executors share. Its key holds the digest of the vocabulary file, so counts of another
tokenizer or version are never used.

Scale: the one large exchange carries each distinct missing content once per map task, keyed by
digest, with partial aggregation first, so that a group of copies of any size sends one row per
task. Digests and counts are 60 bytes a document. Contents with more copies than HOT_COPIES, or than
one in MAX_HOT of all documents, are hot, so there are at most MAX_HOT of them, whatever the
input: their counts are broadcast to their documents, and no group of copies meets in one task.

Cases: null counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give repeated results.
An empty table gives no rows. Long texts are whole. Extra columns are ignored. A failed or
repeated append leaves at worst equal entries twice; reads take one per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import new_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
TOKEN_LIMIT = 4096
HOT_COPIES = 500
MAX_HOT = 10_000


def file_version(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def sentencepiece_counter(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A factory, called once per task, of a function from texts to token counts."""

    def make() -> Callable[[list[str]], list[int]]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    return make


def _encode(make: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, make: Callable[[], Callable[[list[str]], list[int]]], version: str, cache: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; new counts are appended to `cache` (a fresh folder by default)."""
    spark = documents.sparkSession
    cache = cache or new_path(spark, "token-cache")
    content = F.coalesce(F.col(text_col), F.lit(""))
    digested = documents.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))

    known = read_cache(spark, cache, version)
    distinct = digested.groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(known.select("digest"), "digest", "left_anti")
    counted = missing.select("digest", "content").mapInArrow(_encode(make), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    rows = digested.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    stored = read_cache(spark, cache, version)
    copies = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_COPIES)
    hot = copies.where(F.col("n") * MAX_HOT > F.lit(documents.count())).select("digest").join(stored, "digest")
    few = spark.createDataFrame(hot.toArrow())  # at most MAX_HOT rows
    result = ["doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    of_hot = rows.join(F.broadcast(few), "digest").select(*result)
    return rows.join(F.broadcast(few.select("digest")), "digest", "left_anti").join(stored, "digest").select(*result).unionByName(of_hot)
