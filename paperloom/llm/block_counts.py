"""Corpus-wide counts of n-grams, asked for by blocks of rows and answered by hash ranges.

Each task packs its rows, as they come, into blocks of about `block_bytes` of text (a longer text is
a block of its own), whatever their ids. A block sends its distinct n-gram keys with its own
counts, cut by hash range; a range is summed in one task over all blocks, and the totals go back
in each block's order. A block thus gets just the part of the model that its texts can reach, a
frequent n-gram costs one entry a block, and no task holds the whole model.

Keys have as many bits as leave 2 ** spare keys to a counted n-gram, so the chance that two
n-grams share a key does not grow with the corpus. Integers travel as compressed byte planes.

Scale: with some hundred GB, blocks x ranges would be rows of a few keys each. From MOST_RANGES ranges on,
counts therefore go through two levels: blocks ask by coarse range, groups of blocks are merged there and
ask by fine range as one, and the totals come back the same way. Rows then hold some hundred keys at every
size up to some 100 TB, their number grows with the input to the power 1.5 over a whole level and no
faster than the keys, and the range of a frequent n-gram gets one entry a group of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import cut
from paperloom.llm.words import blocks, release_memory

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
#: Ranges up to which blocks ask them directly; a block of 8 MB then has some hundred keys for each.
MOST_RANGES = 8192
#: name of a kind of n-gram -> (ascending distinct keys, their bits, one array of counts or more)
Grams = dict[str, tuple[np.ndarray, int, list[np.ndarray]]]
Kinds = dict[str, int]  # name -> how many arrays of counts


def key_bits(n_grams: int, spare: int) -> int:
    return min(max(32, int(n_grams).bit_length() + spare), 64)


def n_ranges(text_bytes: int, range_bytes: int = RANGE_BYTES) -> int:
    return max(1, -(-int(text_bytes) // range_bytes))


def sizes(spark: SparkSession, text_bytes: int, block_bytes: int | None = None, range_bytes: int | None = None, largest: int = BLOCK_BYTES) -> tuple[int, int]:
    """Bytes of a block and of a range: `largest` and RANGE_BYTES, or on little text so few that every core has some. Counts do not depend on them."""
    cores = spark.sparkContext.defaultParallelism
    block = block_bytes or min(largest, max(1 << 20, int(text_bytes) // (4 * cores)))
    return block, range_bytes or min(RANGE_BYTES, max(2 << 20, int(text_bytes) // (2 * cores)))


def pack_integers(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_integers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)


def pack_counts(counts: list[np.ndarray]) -> bytes:
    """Arrays of counts side by side: a table of the combinations that occur, and each place's rank in it by frequency."""
    table, code, n = _combinations(counts)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    parts = [pack_integers(rank[code]), pack_integers(table[order].reshape(-1))]
    return len(parts[0]).to_bytes(8, "little") + b"".join(parts)


def _combinations(counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    widths = [int(c.max(initial=0)) + 1 for c in counts]
    if math.prod(widths) >= 1 << 62:
        table, code, n = np.unique(np.stack(counts, axis=1), axis=0, return_inverse=True, return_counts=True)
        return table, code.reshape(-1), n
    whole = np.zeros(len(counts[0]), dtype=np.int64)
    for c, width in zip(counts, widths):
        whole = whole * width + c
    found, code, n = np.unique(whole, return_inverse=True, return_counts=True)
    columns = []
    for width in reversed(widths):
        found, c = np.divmod(found, width)
        columns.append(c)
    return np.stack(columns[::-1], axis=1), code, n


def unpack_counts(data: bytes, n: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    rank, table = unpack_integers(data[8 : 8 + size]), unpack_integers(data[8 + size :])
    return list(table.astype(np.int64).reshape(-1, n)[rank.astype(np.int64)].T)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as differences."""
    return pack_integers(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_integers(data), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each hash range begins in ascending keys of so many bits."""
    top = (keys.astype(np.uint64) >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(top, np.arange(ranges + 1, dtype=np.uint64))


def distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and counts of several (keys, counts, ...) merged: ascending keys, summed counts."""
    order, first, found = _ordered([p[0] for p in parts])
    if not len(found):
        return found, [np.empty(0, np.int64) for _ in parts[0][1:]]
    return found, [np.add.reduceat(np.concatenate([p[j] for p in parts])[order], first, dtype=np.int64) for j in range(1, len(parts[0]))]


def _ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts all keys (each array ascends, so runs are merged), where each distinct one then begins, and those."""
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    if len(order) < 1 << 32:
        order = order.astype(np.uint32)
    whole = whole[order]
    first = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(whole) else np.empty(0, np.int64)
    return order, first, whole[first]


def _blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[bytes, pa.Table]]:
    """A task's rows, whose last column is the text, in blocks. The key names task, place and content."""
    task, held, size, n = TaskContext.get().partitionId(), [], 0, 0

    def flush() -> tuple[bytes, pa.Table]:
        nonlocal n
        table = pa.Table.from_batches(held).combine_chunks()
        digest = hashlib.blake2b(f"{task} {n}".encode(), digest_size=16)
        for _, _, block in blocks(table.column(table.num_columns - 1)):
            digest.update(block.row_end.tobytes() + block.data.tobytes())
        n += 1
        held.clear()
        return digest.digest(), table

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low if held else low + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(ends[high - 1]) - before
                low = high
            if low < batch.num_rows:
                yield flush()
                size = 0
    if held:
        yield flush()


def pack_blocks(rows: DataFrame, block_bytes: int, level: int = 5) -> DataFrame:
    """block, rows: one row a block, its rows compressed. The text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
        for name, table in _blocks_of(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return rows.mapInArrow(run, "block binary, rows binary")


def open_block(packed: bytes | pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_py() if isinstance(packed, pa.Scalar) else packed).read_all()


def _asks(blocks_in: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[bytes, pa.Table]]], rows: DataFrame, grams: Callable[[pa.Table], Grams], kinds: Kinds, ranges: int) -> DataFrame:
    names = ["range", "block", *kinds, *(f"{kind}_counts" for kind in kinds)]

    def ask(name: bytes, found: Grams) -> pa.RecordBatch:
        at = {kind: cuts(found[kind][0], found[kind][1], ranges) for kind in kinds}
        used = np.flatnonzero(sum(np.diff(x) for x in at.values()))
        each = {kind: [slice(x[r], x[r + 1]) for r in used] for kind, x in at.items()}
        columns = [[pack_keys(found[kind][0][p]) for p in each[kind]] for kind in kinds]
        columns += [[pack_counts([c[p] for c in found[kind][2]]) for p in each[kind]] for kind in kinds]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(used), pa.binary()), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in blocks_in(batches):
            yield ask(name, grams(table))
        release_memory()

    return rows.mapInArrow(run, ", ".join(["range int", *(f"{n} binary" for n in names[1:])]))


def asked(packed: DataFrame, grams: Callable[[pa.Table], Grams], kinds: Kinds, ranges: int) -> DataFrame:
    """Of each block and hash range, the keys with the block's counts. packed: block, rows."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Table]]:
        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield name, open_block(rows)

    return _asks(opened, packed, grams, kinds, ranges)


def asked_of_rows(rows: DataFrame, block_bytes: int, grams: Callable[[pa.Table], Grams], kinds: Kinds, ranges: int) -> DataFrame:
    """As `asked` of `pack_blocks` of the same rows, in one Python worker a task and without packing."""
    return _asks(lambda batches: _blocks_of(batches, block_bytes), rows, grams, kinds, ranges)


def answered(asks: DataFrame, kinds: Kinds, sums: Callable[[dict[str, list[np.ndarray]]], list[int]] | None = None, sum_names: tuple[str, ...] = ()) -> DataFrame:
    """block, range, and the totals of each kind over all blocks, in each block's order; and `sums` of a range's totals."""
    names = ["block", "range", *(f"{kind}_totals" for kind in kinds)]

    def run(table: pa.Table) -> pa.Table:
        out: list[list[bytes]] = []
        totals: dict[str, list[np.ndarray]] = {}
        for kind, n in kinds.items():
            each = [unpack_keys(x.as_py()) for x in table[kind]]
            ends = np.cumsum([len(k) for k in each])[:-1]
            order, first, found = _ordered(each)
            del each
            place = np.empty(len(order), dtype=order.dtype)
            place[order] = np.repeat(np.arange(len(first), dtype=order.dtype), np.diff(np.append(first, len(order))))
            del order, first
            places = np.split(place, ends)
            totals[kind] = [np.zeros(len(found), dtype=np.int64) for _ in range(n)]
            for p, x in zip(places, table[f"{kind}_counts"]):
                for total, c in zip(totals[kind], unpack_counts(x.as_py(), n)):
                    total[p] += c  # a block has a key once
            out.append([pack_counts([t[p] for t in totals[kind]]) for p in places])
        release_memory()
        more = [pa.array([int(x)] * table.num_rows, pa.int64()) for x in (sums(totals) if sums else [])]
        return pa.table([table["block"], table["range"], *(pa.array(x, pa.binary()) for x in out), *more], names=[*names, *sum_names])

    schema = ", ".join(["block binary", "range int", *(f"{n} binary" for n in names[2:]), *(f"{n} long" for n in sum_names)])
    return asks.groupBy("range").applyInArrow(run, schema)


def _merge(kinds: Kinds, bits: Kinds, ranges: int):
    """The asks of a group of blocks for a coarse range as one block's, cut by fine ranges."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, counts = {}, {}
        for kind, n in kinds.items():
            parts = [(unpack_keys(k.as_py()), *unpack_counts(c.as_py(), n)) for k, c in zip(table[kind], table[f"{kind}_counts"])]
            found[kind], counts[kind] = distinct(parts)
        at = {kind: cuts(found[kind], bits[kind], ranges) for kind in kinds}
        used = np.flatnonzero(sum(np.diff(x) for x in at.values()))
        each = {kind: [slice(x[r], x[r + 1]) for r in used] for kind, x in at.items()}
        columns = [[pack_keys(found[kind][p]) for p in each[kind]] for kind in kinds]
        columns += [[pack_counts([c[p] for c in counts[kind]]) for p in each[kind]] for kind in kinds]
        name = int(key[0].as_py()).to_bytes(8, "big") + int(key[1].as_py()).to_bytes(8, "big")
        release_memory()
        return pa.table([pa.array(used, pa.int32()), pa.array([name] * len(used), pa.binary()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", "block", *kinds, *(f"{kind}_counts" for kind in kinds)])

    return run


def _part(kinds: Kinds):
    """The totals of a group of blocks dealt out to its blocks, each in the order of its own keys."""

    def run(asks: pa.Table, answers: pa.Table) -> pa.Table:
        totals, out = totals_of(answers, kinds), []
        for kind in kinds:
            each = [unpack_keys(x.as_py()) for x in asks[kind]]
            found = _ordered(each)[2]
            out.append([pack_counts([t[np.searchsorted(found, keys)] for t in totals[kind]]) for keys in each])
        release_memory()
        return pa.table([asks["block"], asks["range"], *(pa.array(x, pa.binary()) for x in out)], names=["block", "range", *(f"{kind}_totals" for kind in kinds)])

    return run


def totalled(
    asks: Callable[[int], DataFrame], ranges: int, blocks_in_all: int, bits: Kinds, kinds: Kinds, sums: Callable[[dict[str, list[np.ndarray]]], list[int]] | None = None, sum_names: tuple[str, ...] = (), most_ranges: int = MOST_RANGES
) -> tuple[DataFrame, DataFrame | None]:
    """The answers to `asks` (a function of the number of ranges) by block, in one level or two; and a row of sums for each range, where asked for.

    bits: of each kind's keys. blocks_in_all may be an estimate.
    """
    if ranges <= most_ranges:
        found = answered(asks(ranges), kinds, sums, sum_names)
        if not sums:
            return found, None
        found = cut(found, "ngram-totals")
        return found.drop(*sum_names), found.select("range", *sum_names).distinct()
    coarse = math.isqrt(ranges - 1) + 1
    fine = -(-ranges // coarse)
    groups = max(1, -(-blocks_in_all // coarse))
    dealt = cut(asks(coarse).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))), "asks")
    names = ", ".join(["range int", "block binary", *(f"{kind} binary" for kind in kinds), *(f"{kind}_counts binary" for kind in kinds)])
    merged = dealt.groupBy("range", "group").applyInArrow(_merge(kinds, bits, coarse * fine), names)
    found = cut(answered(merged, kinds, sums, sum_names), "ngram-totals")
    number = lambda low: F.conv(F.hex(F.substring("block", low, 8)), 16, 10).cast("long")
    of_group = found.drop(*sum_names).withColumn("coarse", number(1)).withColumn("group", number(9))
    schema = ", ".join(["block binary", "range int", *(f"{kind}_totals binary" for kind in kinds)])
    back = dealt.groupBy("range", "group").cogroup(of_group.groupBy("coarse", "group")).applyInArrow(_part(kinds), schema)
    return back, found.select("range", *sum_names).distinct() if sums else None


def totals_of(answers: pa.Table, kinds: Kinds) -> dict[str, list[np.ndarray]]:
    """A block's answers joined to whole arrays, in the order of its keys."""
    answers = answers.sort_by("range")
    out = {}
    for kind, n in kinds.items():
        parts = [unpack_counts(x.as_py(), n) for x in answers[f"{kind}_totals"]]
        out[kind] = [np.concatenate([np.empty(0, np.int64), *(p[j] for p in parts)]) for j in range(n)]
    return out
