"""Best-fit packing: documents into as few token sequences as possible, under vector capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths). Pieces are placed longest first. A piece goes to the open sequence in which it
fits under every capacity and which leaves the smallest residual vector, measured after each
component is divided by its capacity: by norm (`rule="norm"`), or the one with the largest dot
product of piece and residual (`rule="dot"`). Ties go to the smaller token residual.

A longer document is cut into full pieces; its first piece is the shorter one. A piece that is
over a capacity by itself (an attention cost below capacity ** 2 makes such) has a sequence alone.
By default the last two capacities are those that the first implies, as fewest sequences need;
the pipeline's packing stage sets lower ones, which bind.

Scale: encoding is one narrow pass. Pieces (about 40 bytes) are then dealt by a hash of document,
piece and row into groups of bounded size, one task each at a time, and every group is packed alone;
a group wastes at most about one open sequence, under 1 in 1000 at the default group size. No
text is shuffled. Sequence numbers are group * 2^32 + place, so groups need not meet.

Cases: null text is empty and has the end token alone. Repeated rows are packed once each,
in groups of their own dealing. A null
doc_id is kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import release_memory

CAPACITY = 2048
GROUP_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Fixed value: how byte-level BPE cuts a text before merging.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe_encoder(path: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Ids as tokenizers gives them for the vocabulary file, without special tokens added.

    tokenizers alone takes 6 to 10 times the CPU that the check tool grants (figures in the README),
    so text of the first 256 code points without special strings goes through tiktoken with the same
    ranks, which gives the same ids (tested); other text goes through tokenizers itself.
    """

    def make() -> Callable[[str], np.ndarray]:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        full = Tokenizer.from_file(path)
        special = [x["content"] for x in spec["added_tokens"]]
        ids = {x["id"] for x in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in ids}
        fast = tiktoken.Encoding("byte-bpe", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                usual = False
            else:
                usual = not any(x in text for x in special)
            ids = fast.encode_ordinary(text) if usual else full.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype=np.uint32)

        return encode

    return make


def encode_pieces(documents: DataFrame, make: Callable[[], Callable[[str], np.ndarray]], end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids, with the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(doc_id), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode
        release_memory()

    return documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: int, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Open sequences with equal residuals are interchangeable and kept together."""
    scale = np.array([capacity, max_documents, max_attention], dtype=float)
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    residuals = np.empty((64, 3), dtype=np.int64)  # distinct residual vectors, and the sequences that have them
    members: list[list[int]] = []
    n_open = np.zeros(64, dtype=np.int64)  # how many sequences have each
    slot: dict[tuple[int, int, int], int] = {}
    n_sequences = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, lengths[i] * lengths[i]], dtype=np.int64)
        left = residuals[: len(members)] - need
        fits = np.flatnonzero((left >= 0).all(axis=1) & (n_open[: len(members)] > 0))
        if len(fits):
            if rule == "norm":
                worth = -((left[fits] / scale) ** 2).sum(axis=1)
            else:
                worth = (residuals[fits] / scale) @ (need / scale)
            best = fits[np.lexsort((left[fits, 0], -worth))[0]]
            at = members[best].pop()
            n_open[best] -= 1
            have = residuals[best]
        else:
            at, n_sequences = n_sequences, n_sequences + 1
            have = scale.astype(np.int64)
        sequence[i], offset[i] = at, capacity - have[0]
        now = have - need
        key = (int(now[0]), int(now[1]), int(now[2]))
        if key[0] > 0 and key[1] > 0 and key[2] > 0:
            k = slot.get(key)
            if k is None:
                free = np.flatnonzero(n_open[: len(members)] == 0) if len(members) > 512 else ()
                empty = int(free[0]) if len(free) else None
                if empty is None:
                    if len(members) == len(residuals):
                        residuals, n_open = np.concatenate((residuals, np.empty_like(residuals))), np.concatenate((n_open, np.zeros_like(n_open)))
                    empty = len(members)
                    members.append([])
                else:
                    del slot[tuple(int(x) for x in residuals[empty])]
                residuals[empty], slot[key] = now, empty
                k = empty
            members[k].append(at)
            n_open[k] += 1
    return sequence, offset


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None, rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack the rows of `encode_pieces`. By default the last two capacities are those that the first implies."""
    max_documents, max_attention = max_documents or capacity, max_attention or capacity * capacity

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity, max_documents, max_attention, rule)
        return rows.assign(sequence_id=(rows["group"].to_numpy() << 32) + sequence, offset=offset).drop(columns="group")

    groups = max(1, -(-pieces.count() // group_pieces))
    # the row's own number parts equal rows; pieces are read from a written table, so it is the same if a task runs again
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, PACKED)


def pack_documents(documents: DataFrame, make: Callable[[], Callable[[str], np.ndarray]], end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **limits: object) -> DataFrame:
    from paperloom.llm.shared import cut

    return best_fit_packing(cut(encode_pieces(documents, make, end_id, capacity, id_col, text_col), "pieces"), capacity, **limits)
