"""N-gram Jaccard join: pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash banding: `choose_bands` takes, for the threshold and a target recall, the longest bands
that a bounded number of hash values allows. Documents are shuffled on their band hashes; those
that share a band hash are candidates; candidates are verified on their full shingle sets.

Documents with equal sets are one node, however many there are. Every bucket of a band gives a
star of candidate edges around its least node, never all pairs, and connected candidates form a
group. A group is verified exhaustively inside tasks: a group of more than BLOCK nodes or
BLOCK_SHINGLES shingles is cut into parts of about that size and every two parts meet in a task of
their own, so no group lands in one task and pairs are counted, not emitted. Because every pair of
a group is verified, no link found by any band is lost to a bucket's size. (Verifying bucket by
bucket would send a document's shingles once for each of its bands; a group sends them once.)

Scale: two narrow passes over the texts; the second takes only documents that have candidates,
after a join on doc_id and a hash of the text that carries their text once. Band rows are 24 bytes. Nodes and classes are
64-bit digests of shingle sets. Components are found by distributed contraction. Small groups are
bundled, some BUNDLE nodes or BUNDLE_SHINGLES shingles at a time, however long their texts are.

Result: one row per document: doc_id; class_id, the least doc_id of its connected component;
n_links, the number of other documents of similarity 0.8 or more; copy_id, the least doc_id
with the same shingle set; n_copies, how many have it.

Cases: a text of fewer than five words has its whole word sequence as its one shingle. Texts
without words (null, empty, white space) equal each other and link to nothing else. Rows without a
doc_id are documents like others; class_id and copy_id are null where no document of the class, or no copy,
has one. A repeated doc_id counts as another document. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.shared import cut
from paperloom.llm.words import Block, blocks, mix, release_memory, window_hashes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 320
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
BUNDLE = 500
BUNDLE_SHINGLES = 1 << 20
_VALUE_BITS = 44


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and for it the fewest bands, that find a pair at the threshold with the target recall."""
    for rows in range(20, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("too few hash values for this recall")


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle values, ascending within each row, and their rows. Rows without words have none."""
    words = block.word_hashes()
    at, rows = block.window_rows(width)
    values = window_hashes(words, width)[at]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < width))
    if len(short):
        place = np.arange(len(words)) - block.first_word[block.row_of_word()]
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * mix(place.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        whole = sums[block.first_word[short + 1]] - sums[block.first_word[short]]
        values = np.concatenate((values, mix(whole + block.n_words[short].astype(np.uint64))))
        rows = np.concatenate((rows, short))
    keys = np.sort((rows.astype(np.uint64) << np.uint64(_VALUE_BITS)) | (values >> np.uint64(64 - _VALUE_BITS)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return keys & np.uint64((1 << _VALUE_BITS) - 1), (keys >> np.uint64(_VALUE_BITS)).astype(np.int64)


def set_nodes(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """A 64-bit digest of each row's set; rows without words have 0."""
    nodes = np.zeros(n_rows, dtype=np.uint64)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        nodes[rows[first]] = mix(np.add.reduceat(mix(values), first))
    return nodes.view(np.int64)


def _signer(width: int, bands: int, rows_each: int):
    random = np.random.Generator(np.random.PCG64(71))
    flip = random.integers(0, 2**32, bands * rows_each, dtype=np.uint64).astype(np.uint32)
    factor = random.integers(0, 2**32, bands * rows_each, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    weight = random.integers(0, 2**63, rows_each, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in blocks(batch.column(1)):
                values, rows = shingle_sets(block, width)
                nodes = set_nodes(values, rows, high - low)
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, np.int64)
                keys = np.empty((len(first), bands), dtype=np.uint64)
                seeds = (mix(values) >> np.uint64(32)).astype(np.uint32)
                for band in range(bands):
                    total = np.full(len(first), band + 1, dtype=np.uint64)
                    for j in range(rows_each):
                        k = band * rows_each + j
                        if len(first):
                            total += np.minimum.reduceat((seeds ^ flip[k]) * factor[k], first).astype(np.uint64) * weight[j]
                    keys[:, band] = mix(total)
                counts = np.zeros(high - low + 1, dtype=np.int32)
                counts[rows[first] + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                sizes = np.bincount(rows, minlength=high - low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(nodes), pa.array(sizes, pa.int64()), lists], names=["doc_id", "row", "node", "size", "bands"])
        release_memory()

    return run


def _reader(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy()
            for low, high, block in blocks(batch.column(0)):
                values, rows = shingle_sets(block, width)
                same = np.flatnonzero(set_nodes(values, rows, high - low) == wanted[low:high])  # not so for another row with this doc_id
                ends = np.searchsorted(rows, np.arange(high - low + 1))
                sets = [values[ends[i] : ends[i + 1]].view(np.int64) for i in same]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
                rest = [batch.column(i).slice(low, high - low).take(pa.array(same)) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*batch.schema.names[1:], "shingles"])
        release_memory()

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    column = (np.cumsum(shared) - 1)[column[shared[column]]] if shared.any() else np.empty(0, np.int64)
    owners = owners[shared[np.cumsum(new) - 1]]
    total = np.zeros((n, n), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((n, 4096), dtype=np.float32)
        part[owners[a:b], column[a:b] - low] = 1
        total += part @ part.T
    total[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return total


def link_matrix(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    both = intersections(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    links = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1) >= threshold
    np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray) -> np.ndarray:
    """Of each row, the first row of its component."""
    root = np.arange(len(links))
    while True:
        least = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verifier(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("node", "ascending")])
        same = table["node"].to_numpy()
        table = table.filter(pa.array(np.concatenate(([True], same[1:] != same[:-1]))))  # a repeated doc_id brings its text twice
        component = table["component"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        part, first, second = (table[c].to_numpy() for c in ("part", "i", "j"))
        lists = table["shingles"].combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1]))), len(component))
        n_links, root = np.zeros(len(node), dtype=np.int64), node.copy()
        for a, b in zip(cuts, cuts[1:]):
            links = link_matrix([values[offsets[k] : offsets[k + 1]] for k in range(a, b)], threshold)
            if first[a] != second[a]:  # two parts meet; pairs within a part are another task's
                links &= part[a:b, None] != part[None, a:b]
            n_links[a:b] = links @ copies[a:b]
            root[a:b] = node[a:b][_roots(links)]
        release_memory()
        return pa.table({"node": node, "n_links": n_links, "root": root})

    return run


def ngram_jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bands, rows_each = choose_bands(threshold, recall)
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    signed = cut(documents.mapInArrow(_signer(width, bands, rows_each), "doc_id long, row long, node long, size long, bands array<long>"), "signatures")
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.min(F.struct("row", "doc_id")).alias("reader"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")

    banded = nodes.select(F.explode("bands").alias("key"), "node")
    stars = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", "a")
    groups = connected_components(banded.join(stars, "key").select("a", F.col("node").alias("b")))

    grouped = nodes.select("node", "reader", "copies", "size").join(groups, "node")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_shingles)).cast("long")
    sizes = cut(grouped.groupBy("component").agg(parts.alias("parts"), F.count("*").alias("n"), F.sum("size").alias("size")), "groups")
    n_small, shingles = (x or 0 for x in sizes.where("parts = 1").agg(F.sum("n"), F.sum("size")).first())
    n_bundles = max(1, -(-n_small // BUNDLE), -(-shingles // BUNDLE_SHINGLES))
    members = grouped.drop("size").join(sizes.select("component", "parts"), "component")
    one = (F.col("row") == F.col("reader.row")) & F.col("doc_id").eqNullSafe(F.col("reader.doc_id"))
    read = documents.join(members, one).select("text", "node", "component", "copies", "parts")
    sets = read.mapInArrow(_reader(width), "node long, component long, copies long, parts long, shingles array<long>")
    dealt = (
        sets
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .withColumn("bundle", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(n_bundles))).otherwise(F.xxhash64("component", "i", "j")))
        .withColumn("large", F.when(F.col("parts") == 1, F.lit(0).cast("long")).otherwise(F.col("component")))
        .select("node", "component", "copies", "part", "i", "j", "bundle", "large", "shingles")
    )
    found = cut(dealt.groupBy("bundle", "large", "i", "j").applyInArrow(_verifier(threshold), "node long, n_links long, root long"), "links")

    linked = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    of_node = nodes.select("node", "copy_id", "copies").join(linked, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = of_node.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    of_node = of_node.join(least, "class").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), "copy_id", F.col("copies").alias("n_copies"))
    return signed.select("doc_id", "node").join(of_node, "node").drop("node")
