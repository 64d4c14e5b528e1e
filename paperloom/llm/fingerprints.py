"""Document fingerprints by locally consistent parsing.

A text's bytes are the first level. On every level, runs of one name are merged, then
deterministic coin tossing reduces each name, by its lowest bit that differs from its left
neighbour's, to a label from a set of constant size; local maxima of the labels end phrases. A
phrase is named by a hash of the names in it, and the phrase names are the next level's text.
Where a phrase ends depends on a few neighbours only, so equal substrings get equal phrases away
from their ends, wherever they stand.

The fingerprint holds, for each of SLOTS slots, the least hash of the phrase names of levels
LEVELS in that slot, in one pass (one-permutation MinHash; empty slots borrow from the next full
one). The likeness of two fingerprints is the share of equal slots, which estimates the Jaccard
similarity of their phrase sets.

`edited_fingerprints` compares every text with an edited form and with the next document's text.
Documents are dealt by ranges of their order (doc_id, a hash of the text, the row), sorted within
them and streamed; the first text of a range also goes to the range before. The text is shuffled
once. Ranges hold about equal rows whatever the ids are: their bounds are quantiles of a sample
(SAMPLE_A_RANGE keys a range; at most MAX_SAMPLE, some 24 MB, on the driver, as Spark's own range
partitioning does). Ids far apart, null and repeated ids and repeated rows are so spread; beyond
MAX_SAMPLE / SAMPLE_A_RANGE ranges these grow, which costs time and no memory, as tasks stream.

Cases: null and empty texts have an empty fingerprint, alike (1.0) among themselves and unlike
(0.0) to others. Ids are expected to be unique and not null; a null id counts as the least one, and
rows with equal ids stand in the order of a hash of their texts, each followed by the next row. A
lone document follows itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import BLOCK_BYTES, mix

SLOTS = 64
LEVELS = (2, 3)
RANGE_ROWS = 1_000
RANGES_A_TASK = 4
SAMPLE_A_RANGE = 20
MAX_SAMPLE = 1_000_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EMPTY = np.uint16(0)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NAMES = mix(np.arange(1, 257, dtype=np.uint64))


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Coin tossing: labels of at most 3 bits; neighbours that differ keep different labels. A text's first name has no left neighbour."""
    differ = names[1:] ^ names[:-1]
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = np.empty(len(names), dtype=np.uint8)
    label[1:] = (low << 1) | ((names[1:] >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label[starts] = (names[starts] & np.uint64(1)).astype(np.uint8)
    for _ in range(2):  # 7 bits, then 4, then 3
        first = label[starts] & 1
        differ = label[1:] ^ label[:-1]
        low = np.bitwise_count((differ & (~differ + np.uint8(1))) - np.uint8(1))
        label[1:] = (low << 1) | ((label[1:] >> low) & 1)
        label[starts] = first
    return label


def next_level(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the texts whose names stand one after another, and the text of each phrase."""
    # runs of one name within one text become one name
    new = np.empty(len(names), dtype=bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if len(first) < len(names):
        run = np.diff(np.append(first, len(names)))
        names, text = names[first], text[first]
        long = run > 1
        names[long] = mix(names[long] + run[long].astype(np.uint64) * _STEP)
    last = np.append(text[1:] != text[:-1], True)
    starts = np.flatnonzero(np.append(True, last[:-1]))
    label = _labels(names, starts)
    ends = np.zeros(len(names), dtype=bool)
    ends[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    ends[starts] = False
    ends |= last
    begins = np.flatnonzero(np.append(True, ends[:-1]))
    size = np.diff(np.append(begins, len(names)))
    place = np.arange(len(names)) - np.repeat(begins, size)
    total = np.add.reduceat(mix(names + (place.astype(np.uint64) + np.uint64(1)) * _STEP), begins)
    return mix(total), text[begins]


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SLOTS 16-bit values per text; texts are consecutive byte ranges."""
    n = len(offsets) - 1
    out = np.full((n, SLOTS), 2**32 - 1, dtype=np.uint32)
    sizes = np.diff(offsets)
    if len(data):
        names, text = _NAMES[data], np.repeat(np.arange(n), sizes)
        for level in range(1, max(LEVELS) + 1):
            names, text = next_level(names, text)
            if level in LEVELS:
                seen = mix(names)
                slot = (seen >> np.uint64(58)).astype(np.int64)
                np.minimum.at(out.reshape(-1), text * SLOTS + slot, (seen & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    empty = out == 2**32 - 1
    step = 1
    while step < SLOTS:  # each empty slot takes the next full one's value, around the circle
        other, other_empty = np.roll(out, -step, axis=1), np.roll(empty, -step, axis=1)
        take = empty & ~other_empty
        # values that have travelled are told apart by how far, through the doubling of steps
        out[take] = other[take] * np.uint32(2654435761) + np.uint32(step)
        empty &= ~take
        step *= 2
    small = (out >> np.uint32(16)).astype(np.uint16) | np.uint16(1)
    small[sizes == 0] = _EMPTY
    return small


def as_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from paperloom.llm.words import blocks

        for batch in batches:
            for low, high, block in blocks(batch.column(1)):
                found = sketches(block.data, np.append(block.row_start, len(block.data)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(as_text(found))], names=["doc_id", "fingerprint"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """rows: doc_id, text, next text; each next text is also fingerprinted here unless it is the next row's own."""
    edited, n_chars = [], []
    for _, text, after in rows:
        n = len(text) // 4
        edited.append((text[: len(text) - n] + after[:n]).encode())
        n_chars.append(len(text))
    own = sketches(*_joined([text.encode() for _, text, _ in rows] + [rows[-1][2].encode()]))
    changed = sketches(*_joined(edited))
    mine, following = own[:-1], own[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(as_text(mine)), pa.array(as_text(changed)), pa.array(likeness(mine, changed)), pa.array(likeness(mine, following))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and id; a tail row ends its range and only lends its text."""
    held: list[tuple[int | None, str]] = []
    size = 0

    def flush(after: str) -> pa.RecordBatch:
        nonlocal size
        rows = [(d, t, held[k + 1][1] if k + 1 < len(held) else after) for k, (d, t) in enumerate(held)]
        held.clear()
        size = 0
        return _compare(rows)

    for batch in batches:
        for doc_id, text, tail in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("tail").to_pylist()):
            text = text.as_py() or ""
            if tail:
                if held:
                    yield flush(text)
                continue
            if size >= BLOCK_BYTES // 2:
                yield flush(text)
            held.append((doc_id, text))
            size += len(text)
    if held:
        yield flush(held[0][1])


_ORDER = np.dtype([("rank", np.int64), ("hash", np.int64), ("row", np.int64)])


def _keys(*columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype=_ORDER)
    for name, column in zip(_ORDER.names, columns):
        out[name] = column
    return out


def range_bounds(ordered: DataFrame, range_rows: int) -> np.ndarray:
    """Ascending keys at which ranges of about `range_rows` rows begin, the first range excepted. ordered: rank, hash, row."""
    n = ordered.count()
    ranges = -(-n // range_rows)
    wanted = min(ranges * SAMPLE_A_RANGE, MAX_SAMPLE)
    sample = ordered if wanted >= n else ordered.sample(min(1.0, wanted / n), seed=1)
    found = sample.select(*_ORDER.names).toArrow()
    keys = np.sort(_keys(*(c.to_numpy() for c in found.columns)), order=_ORDER.names)
    places = np.arange(1, ranges) * len(keys) // max(ranges, 1)
    bounds = np.unique(keys[places]) if len(keys) else keys
    # row numbers part equal rows alone: elsewhere a bound takes all rows of its id and text
    alone = np.ones(len(bounds), dtype=bool)
    same = bounds[["rank", "hash"]]
    alone[1:] &= same[1:] != same[:-1]
    alone[:-1] &= same[1:] != same[:-1]
    bounds["row"][alone] = -1
    return bounds


def in_order(documents: DataFrame) -> DataFrame:
    """doc_id and text, with the columns of their order."""
    rank, content = F.coalesce("doc_id", F.lit(-(1 << 63))), F.coalesce("text", F.lit(""))
    return documents.select("doc_id", "text", rank.alias("rank"), F.xxhash64(content).alias("hash"), F.monotonically_increasing_id().alias("row"))


def edited_fingerprints(documents: DataFrame, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCHEMA for every document: its fingerprint, and those of its edited text and of the next text compared."""
    spark = documents.sparkSession
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = in_order(documents)
    bounds = spark.sparkContext.broadcast(range_bounds(ordered, range_rows))
    n_ranges = len(bounds.value) + 1

    @F.pandas_udf("int")
    def range_of(rank: pd.Series, hash: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _keys(rank, hash, row), side="right").astype(np.int32))

    # the row that is a bound begins a range; rows that are equal to it but for their number have its text
    starts = pd.DataFrame({"rank": bounds.value["rank"], "hash": bounds.value["hash"], "range": np.arange(n_ranges - 1, dtype=np.int32)})
    before = F.broadcast(spark.createDataFrame(starts, "rank long, hash long, range int"))
    tails = ordered.join(before, ["rank", "hash"]).groupBy("range").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    first = ordered.select(F.struct("rank", "hash").alias("at")).agg(F.min("at").alias("at")).select("at.*", F.lit(n_ranges - 1).alias("range"))
    tails = tails.unionByName(ordered.join(F.broadcast(first), ["rank", "hash"]).groupBy("range").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    rows = ordered.select(range_of("rank", "hash", "row").alias("range"), "doc_id", "text", "rank", "hash", F.lit(False).alias("tail"))
    ends = tails.select("range", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("hash"), F.lit(True).alias("tail"))
    dealt = rows.unionByName(ends).repartition(max(1, -(-n_ranges // RANGES_A_TASK)), "range").sortWithinPartitions("range", "tail", "rank", "hash", "text")
    return dealt.select("range", "doc_id", "text", "tail").mapInArrow(_stream, SCHEMA)
