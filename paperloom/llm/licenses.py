"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a window of `block_words` consecutive words that begins at a multiple of half as many, so
every stretch of half a block lies in some block whole. A template is found in a block if at least
`threshold` of the template's distinct words stand in it (containment). The join finds exactly these pairs:

- Words have one order, by how often they stand in all documents, rarest first. Words of no template
  come last in it: they can match nothing, so blocks keep the template words alone.
- Prefix filter: of a template with n words that needs m of them, one of the n - m + 1 first must stand in
  the block, among the block's own first ones. Documents without any such word are left after one
  look; others are joined by these words alone.
- Length filter: the block keeps m words at least. Positional filter: a match at place i of the template
  and j of the block leaves min(n - i, block - j) common words at most, which must reach m.
- Pairs that pass are verified on the whole sets.

Stated phrases (`BASE`) are found besides, at every place where their words stand consecutively.

Scale: texts are read twice, once for the frequencies of the templates' words, once for the join.
Templates are a parameter, some hundred words that every task holds, whatever the input. What is
exchanged is a row a document, and the pairs found. A long text is many blocks, which are rows of their own.

Cases: null and empty texts have no words, no labels and a score of 0. Texts are whole. Repeated rows and
null ids give repeated results; rows of one id with different texts are apart (they are told by a digest of
the text). Ties: labels are sets, sorted. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates: a label and the words that notices of that license begin with, without what differs between versions.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("creative-commons", "this work is licensed under a creative commons attribution international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD, BLOCK_WORDS = 0.8, 64
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text whose capitals are still there.
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({_WORD})"), 1)


def _any_of(phrases: list[str]) -> str:
    """A pattern for any of the phrases as whole words, whatever stands between the words; small and capital letters alike."""
    return rf"(?i)(?<!{_WORD_ANY_CASE[:-1]})(?:" + "|".join(_BETWEEN.join(p.split(" ")) for p in phrases) + rf")(?!{_WORD_ANY_CASE[:-1]})"


def word_frequencies(documents: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of these words stands in all documents: one row a word, whatever the input."""
    found = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"), 1)).alias("word"))
    counts = {r["word"]: r["n"] for r in found.where(F.col("word").isin(words)).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in words}


def template_sets(templates: list[tuple[str, str]], threshold: float) -> list[tuple[str, list[str], int]]:
    """Label, distinct words, and how many of them a block must hold."""
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in templates]
    return [(label, words, max(1, math.ceil(round(threshold * len(words), 9)))) for label, words in sets]


def _row(word: str, i: int, label: str, words: list[str], need: int) -> Column:
    return F.struct(F.lit(word).alias("word"), F.lit(i).alias("i"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"))


def block_labels(documents: DataFrame, templates: list[tuple[str, str]], threshold: float, block_words: int) -> DataFrame:
    """doc_id, digest, found (labels) and score of the documents in which a template is found. documents: doc_id, text, digest."""
    sets = template_sets(templates, threshold)
    frequency = word_frequencies(documents, sorted({w for _, words, _ in sets for w in words}))
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    rank = {w: k for k, w in enumerate(order)}
    sets = [(label, sorted(words, key=rank.get), need) for label, words, need in sets]
    prefixes = [(w, i, label, words, need) for label, words, need in sets for i, w in enumerate(words[: len(words) - need + 1])]
    index = documents.sparkSession.range(1).select(F.inline(F.array(*(_row(*p) for p in prefixes))))

    hopeful = documents.where(F.col("text").rlike(_any_of(sorted({p[0] for p in prefixes}))))
    step = block_words // 2
    # the last start from which on a block holds words that the one before lacks
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - step - 1), F.lit(step))
    blocks = hopeful.select("doc_id", "digest", _words(F.col("text")).alias("w")).select("doc_id", "digest", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(block_words)))).alias("block"))
    kept = blocks.select("doc_id", "digest", F.array_intersect(F.array(*map(F.lit, order)), "block").alias("block"))
    least = min(need for _, _, need in sets)
    asked = kept.where(F.size("block") >= least).select("doc_id", "digest", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - least + 1)).alias("j", "word"))
    pairs = asked.join(F.broadcast(index), "word")
    size, n = F.size("block"), F.size("words")
    passing = pairs.where((F.col("j") <= size - F.col("need")) & (F.least(n - F.col("i"), size - F.col("j")) >= F.col("need")))
    common = F.size(F.array_intersect("words", "block"))
    verified = passing.select("doc_id", "digest", "label", (common / n).alias("score"), (common >= F.col("need")).alias("found")).where("found")
    return verified.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))


def base_places(words: Column, phrases: dict[str, str]) -> Column:
    """array<struct<start, label>>: every place where a phrase's words stand consecutively."""

    def places(phrase: str, label: str) -> Column:
        wanted = F.array(*map(F.lit, phrase.split()))
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda i: F.slice(words, i, F.size(wanted)) == wanted)
        return F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.flatten(F.array(*(places(p, label) for p, label in phrases.items())))


def license_scan(
    documents: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score: 1 where a stated phrase stands, else the largest containment of a template found, else 0.
    """
    base, templates = base or BASE, templates or TEMPLATES
    longest = max(len(text.split()) for _, text in templates)
    if block_words < 2 * longest:
        raise ValueError(f"blocks of {block_words} words are less than twice as long as the longest template ({longest})")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    found = block_labels(rows, templates, threshold, block_words)

    words = F.when(F.col("text").rlike(_any_of(list(base))), _words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    own = rows.select("doc_id", "digest", F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), words.alias("w"))
    own = own.select("doc_id", "digest", "n_words", F.when(F.size("w") > 0, base_places(F.col("w"), base)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"))
    met = own.alias("o").join(found.alias("f"), F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o.digest") == F.col("f.digest")), "left")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    stated, method = F.col("places.label"), F.coalesce("found", F.array().cast("array<string>"))
    return met.select(
        "o.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(stated).alias("base_labels"),
        joined(F.concat(stated, method)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
