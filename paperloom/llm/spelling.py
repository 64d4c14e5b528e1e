"""Spelling variant grouping: words at edit distance 1, found by a rare-first prefix filter over positional bigrams.

Bigrams have one order for all words: rarest in the vocabulary first, then by their letters, and in a
word by place. Of two words at distance 1 the edit touches two bigrams of each at most, the others
stand in both in one order, so the first of those is among the three rarest of both words: only these
three of a word are joined. Equal places are not enough: the edit lies wholly left or wholly right
of that bigram, so either both words agree up to it, at the same place from the left, or they agree
from it on, at the same place from the right. The join key is that agreeing part with the length of
the shorter word, which states bigram, place, position and length limits at once. Where the agreeing
part is less than half a word, a half of the other part is in the key too, the one or the other: the
edit spares one of them. Candidates are verified by their edit distance.

Of a word's near words the most frequent, at `factor` times its own count or more, is its form. Forms
are followed to the last by doubling: each step up multiplies the count by `factor`, so paths are short.

Scale: texts are read once, narrow, and only distinct words are exchanged, with counts combined in each
task. The bigrams' frequencies are the one table that tasks get whole: words have 90 different letters,
hence 8,100 bigrams at most. Keys are hashed; words that meet by chance are verified like others. Keys
that many words share are dealt over parts, every two of which meet in a task of their own, so no task
holds a whole key. Only pairs at distance 1 leave the join.

Cases: null and empty texts have no words. A null id counts as the text `null` in the planted edits.
Repeated rows count as often as they stand. Words of any length are compared whole. Ties of the most
frequent near word go to the least by code points. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Members of a join key that one part holds.
PART = 1000
PREFIX = 3


def edited_words(documents: DataFrame, min_length: int = 7, every: int = 31) -> DataFrame:
    """`word` once an occurrence: runs of letters in lower case, one in `every` of which (by checksum of id and run) lost a letter."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN})"), 1)).alias("run")
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), runs).where(F.length("run") >= min_length)
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    place = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.pmod("h", F.lit(every)) == 0, shorter).otherwise(F.col("run"))
    return found.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length)


def bigram_frequencies(words: DataFrame) -> np.ndarray:
    """How often each bigram stands in the distinct words, by its two letters' codes: 256 x 256 at most, whatever the vocabulary."""
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram")
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in words.select(grams).groupBy("gram").count().collect():  # at most 8,100 rows
        counts[int.from_bytes(r["gram"].encode("latin-1"), "big")] = r["count"]
    return counts


def _agreeing_parts(frequency: np.ndarray):
    """(key, word) for the rarest bigrams of each word, as the shorter of a pair (or of equal length) and as the longer."""
    rank = np.lexsort((np.arange(1 << 16), frequency)).argsort().tolist()

    def keys_of(word: str) -> Iterator[str]:
        data, n = word.encode("latin-1"), len(word)
        rarest = sorted((rank[a << 8 | b], k) for k, (a, b) in enumerate(zip(data, data[1:])))[:PREFIX]
        for _, k in rarest:
            for side, agreed, other in (("<", word[: k + 2], word[k + 2 :]), (">", word[k:], word[:k])):
                for shorter in (n, n - 1):
                    left = shorter - len(agreed)  # letters of the shorter word's other part
                    if left < 0:
                        continue
                    name = f"{side}{shorter} {agreed}"
                    if 2 * len(agreed) >= shorter:
                        yield name
                    else:
                        half = left // 2
                        yield f"{name} {other[:half]}+"
                        yield f"{name} +{other[len(other) - (left - half) :]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for word in batch.column(0).to_pylist():
                found = list(keys_of(word))
                keys += found
                words += [word] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["key", "word"])

    return run


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, b), a < b: all pairs of distinct words at edit distance 1. words: `word`, distinct, of letters up to U+00FF, five or more."""
    members = words.select("word").mapInArrow(_agreeing_parts(bigram_frequencies(words)), "key string, word string")
    members = cut(members.select(F.xxhash64("key").alias("key"), "word"), "members")
    hot = cut(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > part), "hot_keys")
    near = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)

    own = members.join(hot, "key", "left_anti").repartition("key")
    met = own.select("key", F.col("word").alias("a")).join(own.select("key", F.col("word").alias("b")), "key").where(F.col("a") < F.col("b"))

    split = members.join(hot, "key").withColumn("parts", F.ceil(F.col("size") / part).cast("int")).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))

    def side(name: str, low: Column, high: Column) -> DataFrame:
        # each two parts of a key meet once: a part goes out as first with itself and those behind, as second with itself and those before
        return split.select("key", F.col("word").alias(name), F.col("mine").alias(f"{name}_part"), F.explode(F.sequence(low, high)).alias("other"))

    first = side("a", F.col("mine"), F.col("parts") - 1).withColumnRenamed("other", "b_part")
    second = side("b", F.lit(0), F.col("mine")).withColumnRenamed("other", "a_part")
    met_in_parts = first.join(second, ["key", "a_part", "b_part"]).where((F.col("a_part") < F.col("b_part")) | (F.col("a") < F.col("b")))
    found = met.where(near).select("a", "b").unionByName(met_in_parts.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last; no path may close."""
    paths = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut(paths.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        paths = step.select("word", "root")
        if step.where("moved").isEmpty():
            return paths


def spelling_variants(documents: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every distinct word of so many letters and occurrences."""
    if min_length < 5:
        raise ValueError("words of fewer than five letters can lose all their bigrams to one edit")
    documents = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = cut(edited_words(documents, min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "words")
    pairs = cut(near_pairs(words, part), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("word"), F.col("b").alias("near"))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    found = words.join(best, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = cut(found, "forms")
    roots = followed(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
