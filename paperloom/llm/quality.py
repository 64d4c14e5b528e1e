"""Quality rules: n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs of every whole text are counted by hash in two multinomials: one over all
documents (raw), one over trusted documents (target; all of them up to TRUSTED, then the TRUSTED least by a hash of
the id). A document's score is the sum of
log(target / raw) over its n-grams divided by their number; it is kept if the score reaches
`threshold`, a constant. A base rule comes before: too few words, or too many words in repeated
windows, fail.

Keys have as many bits as leave 2 ** SPARE_BITS of them to a counted n-gram, so some 20 or more to a
distinct one, whatever the input's size: the share of rare n-grams that frequent ones cover for is
small and does not grow with the corpus.

Scale: the model is never in one place; see block_counts. Exchanged: the compressed text once, and
per block and distinct n-gram about 2.5 bytes there and 1 back. The ids of trusted documents are
broadcast, at most 8 MB at any size of input.

Blocks are packed twice, once to ask and once to score. Rows that come in another order the second
time (as after a shuffle without a total order) make the query fail, never a wrong score; write
such a table first.

Not caught: toxic text of good form. Toxic documents are left out of the target, but their n-grams
are mostly those of others; see the README for how many pass.

Cases: a null or empty text has no words, so base_failed and not kept. A null doc_id stays null
and is never trusted. Repeated rows give repeated results. An empty table gives no rows. Without
trusted documents every ratio is 0 and the base rule alone decides. Columns other than
those named are ignored unless listed in `keep`; measures replace kept columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import block_counts as bc
from paperloom.llm.words import Block, blocks, inside_words, mix, release_memory, repeated, window_hashes

#: The labelled rows that the target is fitted on, at most.
TRUSTED = 1_000_000
SPARE_BITS = 3
THRESHOLD = -0.15
PRIOR = 10
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"
_KINDS = {"grams": 2}  # counts in all documents, and in trusted ones

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def ngram_buckets(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and word pair."""
    words = block.word_hashes()
    at, pair_rows = block.window_rows(2)
    pairs = window_hashes(words, 2)[at]
    return np.concatenate((words, pairs)) >> np.uint64(64 - bits), np.concatenate((block.row_of_word(), pair_rows))


def base_measures(block: Block) -> dict[str, np.ndarray]:
    """The counts of the base rule, per row."""
    n_rows, data = len(block.row_start), block.data
    lead = (data & 0xC0) != 0x80
    inside = inside_words(block)
    out = {"n_words": block.n_words, "word_chars": block.count_bytes(inside & lead), "n_symbols": block.count_bytes(_SYMBOL[data])}

    feeds = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate((block.row_start, feeds + 1)))
    row = np.searchsorted(block.row_start, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:] - 1, len(data)), block.row_end[row])
    line_end = np.where(np.append(row[1:] != row[:-1], True), block.row_end[row], line_end)
    words_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(inside, out=words_before[1:])
    worded = (line_end > line_start) & (words_before[np.maximum(line_end, line_start)] > words_before[line_start])
    # a row number in the key keeps equal lines of different rows apart
    keys = mix(block.span_hashes(line_start[worded], line_end[worded]) + mix(row[worded].astype(np.uint64)))
    row = row[worded]
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n_rows) - np.bincount(row[first], minlength=n_rows)

    at, rows = block.window_rows(REPEAT_WINDOW)
    covered = np.zeros(len(block.word_start) + 1, dtype=np.int64)
    if len(at):
        keys = mix(window_hashes(block.word_hashes(), REPEAT_WINDOW)[at] + mix(rows.astype(np.uint64)))
        hits = at[repeated(keys)]
        covered[hits] += 1
        covered[hits + REPEAT_WINDOW] -= 1
    sums = np.zeros(len(block.word_start) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(covered)[:-1] > 0, out=sums[1:])
    out["n_repeat_words"] = sums[block.first_word[1:]] - sums[block.first_word[:-1]]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers that are not negative, held in 4 bytes where they fit."""
    return x.astype(np.uint32) if int(x.max(initial=0)) < 1 << 32 else x


def _is_trusted(ids: pa.Array, trusted: np.ndarray) -> np.ndarray:
    found = np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), trusted)
    return found & ids.is_valid().to_numpy(zero_copy_only=False)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = TRUSTED) -> np.ndarray:
    """Of trusted documents (quality 1, toxic 0 or null), `most` at most. Ascending."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    ids = good.select(F.col(id_col).cast("long").alias("id")).distinct()
    return np.sort(ids.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()["id"].to_numpy())


def _size(trusted):
    """Bytes, n-grams and trusted n-grams of a task's rows of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = raw = target = 0
        for batch in batches:
            of_target = _is_trusted(batch.column(0), trusted.value)
            for low, high, block in blocks(batch.column(1)):
                n = block.n_words + np.maximum(block.n_words - 1, 0)
                size, raw, target = size + len(block.data), raw + int(n.sum()), target + int(n[of_target[low:high]].sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (size, raw, target)], names=["size", "raw", "target"])

    return run


def _grams(trusted, bits: int):
    """The distinct keys of a block and their counts. A block's last columns are id and text."""

    def run(table: pa.Table) -> bc.Grams:
        *_, ids, texts = table.columns
        of_target = _is_trusted(ids.combine_chunks(), trusted.value)
        parts = []
        for low, _, block in blocks(texts):
            keys, rows = ngram_buckets(block, bits)
            found, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place, minlength=len(found)), np.bincount(place[of_target[rows + low]], minlength=len(found))
            parts.append((found, *(_narrow(c) for c in counts)))
        found, counts = bc.distinct(parts)
        return {"grams": (found, bits, counts)}

    return run


def _score(kept_at: list[int], schema_names: list[str], threshold: float, bits: int, scale: float):
    names = schema_names[len(kept_at) :]
    reordered = "documents came in another order when they were read again; write the table first"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError(reordered)
        table = bc.open_block(left["rows"][0])
        texts = table.column(table.num_columns - 1)
        each = []
        for _, _, block in blocks(texts):
            keys, rows = ngram_buckets(block, bits)
            own, place = np.unique(keys, return_inverse=True)
            each.append((block, own, _narrow(place), _narrow(rows)))
        found = np.unique(np.concatenate([x[1] for x in each]))
        raw, target = bc.totals_of(right, _KINDS)["grams"]
        if len(raw) != len(found):
            raise ValueError(reordered)
        # both multinomials get the same prior weight, PRIOR raw counts a key, so that rare n-grams say little
        model = np.log((target * scale + PRIOR) / (raw + PRIOR)) if scale else np.zeros(len(found))
        parts: list[dict[str, np.ndarray]] = []
        for block, keys, place, rows in each:
            n = len(block.row_start)
            total = np.bincount(rows, weights=model[np.searchsorted(found, keys)][place], minlength=n)
            parts.append({"score": total / np.maximum(np.bincount(rows, minlength=n), 1)} | base_measures(block))
        out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        del each
        release_memory()
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
        out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
        return pa.table([table.column(i) for i in kept_at] + [pa.array(out[k]) for k in names], names=schema_names)

    return run


def quality_rules(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, spare_bits: int = SPARE_BITS, block_bytes: int | None = None, range_bytes: int | None = None, most_ranges: int = bc.MOST_RANGES, largest_block: int = bc.BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the kept columns (doc_id alone by default) and MEASURES."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    keep = [c for c in (keep or [id_col]) if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema] + [MEASURES])
    trusted = documents.sparkSession.sparkContext.broadcast(trusted_ids(labels, id_col))
    texts = documents.select(F.col(id_col).cast("long").alias("\tid"), F.col(text_col).alias("\ttext"))
    sizes = texts.mapInArrow(_size(trusted), "size long, raw long, target long")
    size, raw, target = (x or 0 for x in sizes.agg(F.sum("size"), F.sum("raw"), F.sum("target")).first())
    block_bytes, range_bytes = bc.sizes(documents.sparkSession, size, block_bytes, range_bytes, largest_block)
    bits = bc.key_bits(raw, spare_bits)

    # a kept text travels once: it is the last column of a block
    other = [c for c in keep if c != text_col]
    kept_at = [other.index(c) if c != text_col else len(other) + 1 for c in keep]
    rows = documents.select(*other, F.col(id_col).cast("long").alias("\tid"), F.col(text_col).alias("\ttext"))
    packed = bc.pack_blocks(rows, block_bytes, level=9)
    asks = lambda ranges: bc.asked_of_rows(rows, block_bytes, _grams(trusted, bits), _KINDS, ranges)
    answers, _ = bc.totalled(asks, bc.n_ranges(size, range_bytes), bc.n_ranges(size, block_bytes), {"grams": bits}, _KINDS, most_ranges=most_ranges)
    score = _score(kept_at, keep + names, threshold, bits, raw / target if target else 0.0)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
