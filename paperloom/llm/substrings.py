"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller doc_id are removed.

A compressed FM-index per shard (see fm_index): texts are streamed through it backwards over wavelet
matrices, which gives matching statistics: at every place, how many of the next words also stand in what the
shard holds of documents with smaller ids. A match that grows until no such document has it gives up its
last words. Places where 50 words match are reported.

What a shard must hold: every window of 50 words has an anchor, its run of ANCHOR words with the
least hash; equal windows have equal anchors. First only anchors' hashes are counted; those found
in one document alone end there. For the others, each document sends the segment of words that
the windows of an anchor cover. Equal segments are indexed and streamed once, under the least doc_id: in
documents with greater ids they go whole. A shard is dealt by anchor, so equal windows meet in one index.
Anchors found in more than HOT documents are split: each of their windows is a segment of its own, dealt by
its whole hash.

Scale: exchanged are the anchors' hashes (about one in 20 words), the text once to the documents
that share anchors and once for the result, and distinct shared segments at 6 bytes a word. A
shard's index is built in one task from about SHARD_WORDS words. Joins by anchor or segment are salted by
document: those of hot anchors over SALTS tasks each, so boilerplate is not one task's.

Words have 48-bit hashes inside segments: two windows are taken as equal in error only if they
differ in nothing but words of equal hashes.

Cases: null texts have no words; texts of fewer than 50 words lose none. Rows with a null doc_id
are kept whole and remove nothing. Rows with one doc_id do not remove each other's words, and each loses
its own; they are told apart by a 64-bit hash of the text. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.fm_index import FMIndex
from paperloom.llm.shared import cut
from paperloom.llm.words import _BASE, _BASE_INVERSE, Block, _power, blocks, mix, window_hashes

WINDOW = 50
ANCHOR = 12
HOT = 5_000
SHARD_WORDS = 1_000_000
SALTS = 16
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_PLACE_BITS = np.uint64(28)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by running minima from both sides of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of a block's rows: key, row, and the window starts from `low` to `high` that each stands for."""

    def __init__(self, block: Block, window: int, anchor: int) -> None:
        self.words = block.word_hashes()
        at, _ = block.window_rows(window)
        grams = window_hashes(self.words, anchor)
        marked = (grams & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_least(marked, window - anchor + 1)[at] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
        self.low = at[first]
        self.high = at[np.append(first[1:], len(at)) - 1] if len(at) else self.low
        self.key = grams[place[first]].view(np.int64)
        self.row = block.row_of_word()[self.low]


def _anchor_keys(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for low, _, block in blocks(batch.column(1)):
                found = Anchors(block, window, anchor)
                _, once = np.unique(mix(found.key.view(np.uint64) + mix(found.row.astype(np.uint64))), return_index=True)
                rows = low + found.row[once]
                yield pa.RecordBatch.from_arrays([pa.array(found.key[once]), pa.array(ids[rows]), pa.array(texts[rows])], names=["key", "doc_id", "row"])

    return run


def _span_digests(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each words[low:high]."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=sums[1:])
    return mix((sums[high] - sums[low]) * _power(_BASE_INVERSE, len(words) + 1)[low] + (high - low).astype(np.uint64))


def _segments(window: int, anchor: int):
    """Rows of two kinds: occurrences (doc_id, row, start; no words), and once a task each distinct segment's words with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            wanted = batch.column(2)
            sizes = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            owner = np.repeat(np.arange(len(ids)), sizes)
            keys, hot = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            for start, end, block in blocks(batch.column(1)):
                found = Anchors(block, window, anchor)
                mine = (owner >= start) & (owner < end)
                tagged = mix(keys[mine].view(np.uint64) + mix((owner[mine] - start).astype(np.uint64)))
                order = np.argsort(tagged)
                ask = mix(found.key.view(np.uint64) + mix(found.row.astype(np.uint64)))
                at = np.minimum(np.searchsorted(tagged[order], ask), max(len(tagged) - 1, 0))
                shared = tagged[order][at] == ask if len(tagged) else np.zeros(len(ask), dtype=bool)
                is_hot = np.zeros(len(ask), dtype=bool)
                is_hot[shared] = hot[mine][order][at[shared]]
                low, high, key, row = (x[shared & ~is_hot] for x in (found.low, found.high, found.key, found.row))
                split = np.zeros(len(low), dtype=bool)
                if is_hot.any():  # each window alone, under its own hash
                    n = (found.high - found.low + 1)[is_hot]
                    single = np.repeat(found.low[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    low, high = np.concatenate((low, single)), np.concatenate((high, single))
                    row = np.concatenate((row, np.repeat(found.row[is_hot], n)))
                    split = np.concatenate((split, np.ones(len(single), dtype=bool)))
                    key = np.concatenate((key, _span_digests(found.words, single, single + window).view(np.int64)))
                digest = _span_digests(found.words, low, high + window).view(np.int64)
                doc = ids[start + row]
                packed = found.words.view(np.uint8).reshape(-1, 8)[:, :6]
                new_key, new_digest, new_doc, new_words, new_split = [], [], [], [], []
                for k, d, i, a, b, x in zip(key.tolist(), digest.tolist(), doc.tolist(), low.tolist(), high.tolist(), split.tolist()):
                    before = least.get((k, d))
                    if before is None or i < before:
                        least[k, d] = i
                        new_key.append(k), new_digest.append(d), new_doc.append(i), new_split.append(x)
                        new_words.append(packed[a : b + window].tobytes() if before is None else b"")
                starts = low - block.first_word[row]
                more = pa.nulls(len(new_key), pa.int64())
                columns = [(pa.array(key), pa.array(new_key, pa.int64())), (pa.array(digest), pa.array(new_digest, pa.int64())), (pa.array(doc), pa.array(new_doc, pa.int64())), (pa.array(texts[start + row]), more), (pa.array(starts), more)]
                columns += [(pa.array(split), pa.array(new_split, pa.bool_())), (pa.nulls(len(key), pa.binary()), pa.array(new_words, pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["key", "digest", "doc_id", "row", "start", "split", "words"])

    return run


def _search(window: int):
    """Index a shard's distinct segments, stream them through, and tell each one's runs of windows that documents with smaller ids have."""

    def run(table: pa.Table) -> pa.Table:
        key, digest, doc, split = (table[c].to_numpy() for c in ("key", "digest", "doc_id", "split"))
        texts = [np.frombuffer(x.as_py(), dtype=np.uint8).reshape(-1, 6) for x in table["words"]]
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        key, digest, doc, split, sizes = key[order], digest[order], doc[order], split[order], sizes[order]
        wide = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        wide[:, :6] = np.concatenate([texts[k] for k in order])
        names, symbol = np.unique(wide.view(np.uint64).reshape(-1), return_inverse=True)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(len(symbol) + len(sizes), dtype=np.int64)
        text[np.arange(len(symbol)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol + 1
        rank = np.unique(doc, return_inverse=True)[1].astype(np.int32)
        index = FMIndex(text, len(names) + 1, window, np.repeat(rank, sizes + 1))
        found = index.statistics(text, starts, sizes, rank)
        del index
        n = sizes - window + 1
        owner = np.repeat(np.arange(len(sizes)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hits = np.flatnonzero(found[starts[owner] + offset] >= window)
        owner, offset = owner[hits], offset[hits]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)))) if len(hits) else hits
        length = np.diff(np.append(first, len(owner)))
        runs = pa.StructArray.from_arrays([pa.array(offset[first]), pa.array(length)], names=["offset", "length"])
        cuts = np.searchsorted(owner[first], np.arange(len(sizes) + 1)).astype(np.int32)
        return pa.table([pa.array(key), pa.array(digest), pa.array(doc), pa.array(split), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts), runs)], names=["key", "digest", "least", "split", "size", "runs"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, hashes = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()  # splits bytes at just the six separators
            keep = np.ones(len(words) + 1, dtype=bool)
            for r in ranges.as_py() or ():
                keep[r["low"] : r["high"]] = False
            removed = len(words) - int(keep[: len(words)].sum())
            n_words.append(len(words)), n_removed.append(removed)
            hashes.append(hashlib.sha256(b" ".join(words if not removed else [w for w, k in zip(words, keep) if k])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, row and `ranges`: the word ranges (low, high; end exclusive, perhaps overlapping) to remove. documents: doc_id, text, row (a hash of the text)."""
    documents = documents.where("doc_id IS NOT NULL")
    anchors = documents.select("doc_id", "text", "row").mapInArrow(_anchor_keys(window, anchor), "key long, doc_id long, row long")
    shared = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("key", (F.col("n") > hot).alias("hot"))
    salt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int").alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = anchors.select("key", "doc_id", "row", salt).join(shared.select("key", "hot", each), ["key", "salt"])
    wanted = met.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "hot")).alias("wanted"))
    sent = documents.join(wanted, ["doc_id", "row"]).select("doc_id", "text", "wanted", "row").mapInArrow(_segments(window, anchor), "key long, digest long, doc_id long, row long, start long, split boolean, words binary")
    sent = cut(sent, "segments")

    segments = sent.where("words IS NOT NULL").groupBy("key", "digest", "split").agg(F.min("doc_id").alias("doc_id"), F.max("words").alias("words"))
    n_words = sent.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-n_words // (6 * shard_words)))
    answers = segments.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(_search(window), "key long, digest long, least long, split boolean, size long, runs array<struct<offset:long, length:long>>")
    # windows of hot anchors have an answer for each salt
    salts = F.when(F.col("split"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answers = answers.select("key", "digest", "least", "size", "runs", F.explode(salts).alias("salt"))
    asks = sent.where("words IS NULL").select("key", "digest", "doc_id", "row", "start", F.when(F.col("split"), salt).otherwise(F.lit(0)).alias("salt"))
    whole = F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")))
    parts = F.transform("runs", lambda r: F.struct((F.col("start") + r["offset"]).alias("low"), (F.col("start") + r["offset"] + r["length"] + F.lit(window - 1)).alias("high")))
    hit = asks.join(answers, ["key", "digest", "salt"]).select("doc_id", "row", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(parts).alias("ranges")).where(F.size("ranges") > 0)
    return hit.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def substring_dedup(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCHEMA for every document."""
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    ranges = cut(repeated_ranges(documents, window, anchor, hot, shard_words), "ranges")
    return documents.join(ranges, ["doc_id", "row"], "left").select("doc_id", "text", "ranges").mapInArrow(_remove, SCHEMA)
