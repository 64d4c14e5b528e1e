"""Phrase collocation mining by sorted suffixes: counts of all short phrases with one shuffle and one stack.

Every word of a piece begins a suffix of at most `max_words` words. Suffixes are shuffled by language
and first word, sorted in descending order, and read once: a phrase is open while the suffixes read
begin with it, so a stack with one count for each length of phrase is all that a task holds. Where two
neighbouring suffixes agree in fewer words than before, the longer phrases close and are counted. Then
each phrase is joined with the counts of its two parts, one cut after the other.

Pieces and words are found by vectorised passes over blocks of text, and equal suffixes of a block are
sent once, with their number, neighbours beginning alike. Words travel as codes: two bytes for those of a dictionary, else byte 255,
the word and byte 0 (words' bytes below 9 are raised by one, so 0 is free). No code begins another, so
suffixes that begin with the same words stand together in the order of their bytes.

Scale: what is exchanged is the distinct suffixes of each block. A sample of at most SAMPLE documents
decides on two things that no count depends on. Its most frequent words are the dictionary (64,770 words at most).
Beginnings that are frequent in it, of one word or more, are dealt further, by one word more, so no task
gets all suffixes of one word or of one pair; their own counts come in parts and are summed. A
language's best phrases are chosen in two steps, so no task orders a whole language.

Cases: null and empty texts have no words; they and their rows leave no trace. A null language is
`und`. Long texts are whole. Repeated rows count as often as they stand. An empty table, and languages
without phrases, give no rows. Ties are ordered by the phrase. Ids are not read. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import cut
from paperloom.llm.words import _BASE_INVERSE, _power, _prefix, as_large_string, mix, release_memory

UNKNOWN = "und"
#: Text whose suffixes are counted together before they are sent, and text that is taken apart at a time.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Documents of the sample, and the share of its words from which on the suffixes behind a beginning are dealt further.
SAMPLE, HOT_SHARE = 5_000, 1 / 500
_BLANK, _BREAK, _LITERAL = 1, 2, 255
#: Of each byte: whether it parts words, or words and pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
#: Capitals made small, and byte 0 made free.
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[0x41:0x5B] += 0x20
_BYTE[:9] += 1
_BACK = bytes([0, *range(9), *range(10, 256)])
#: Suffixes that are written out at a time, and counted together at most.
_SLICE, _COUNTED = 1 << 17, 1 << 21


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = _prefix(data)
    return mix((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(data) + 1)[start])


class Dictionary:
    """Two bytes for each of at most 64,770 words: the first from 1 to 254, the second from 1 to 255."""

    SIZE = 254 * 255

    def __init__(self, words: Iterable[bytes] = ()) -> None:
        self.words = list(words)[: self.SIZE]
        n = np.arange(len(self.words))
        self.codes = np.stack([n // 255 + 1, n % 255 + 1], axis=1).astype(np.uint8)
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        end = np.cumsum(size)
        keys = _hashes(np.frombuffer(b"".join(self.words), dtype=np.uint8), end - size, end)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.place = {w: k for k, w in enumerate(self.words)}

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Of words given by their hashes, the place in the dictionary, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(self.codes[self.place[w]].tobytes() if w in self.place else bytes([_LITERAL]) + w + b"\0" for w in words)

    def decode(self, code: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(code):
            if code[at] == _LITERAL:
                end = code.index(0, at)
                out.append(code[at + 1 : end])
                at = end + 1
            else:
                out.append(self.words[(code[at] - 1) * 255 + code[at + 1] - 1])
                at += 2
        return out


class Suffixes:
    """The words of some texts in code, and for each the end of the suffix of at most `max_words` words that it begins."""

    def __init__(self, texts: pa.Array, max_words: int, dictionary: Dictionary) -> None:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        data = np.insert(raw, np.unique(offsets[1:] - offsets[0]), 0x0A)  # a break behind every text
        kind = _KIND[data]
        inside = kind == 0
        before = np.concatenate(([False], inside[:-1]))
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        size, self.n = end - start, len(start)
        letters = _BYTE[data[inside]]  # of all words, one after the other
        at = np.cumsum(size)
        place = dictionary.places(_hashes(letters, at - size, at))
        known = place >= 0
        length = np.where(known, 2, size + 2)
        self.start = np.cumsum(length) - length
        self.data = np.zeros(int(length.sum()), dtype=np.uint8)
        here = self.start[known]
        self.data[here], self.data[here + 1] = dictionary.codes[place[known]].T if len(here) else (0, 0)
        other = ~known
        self.data[self.start[other]] = _LITERAL
        of_other = np.repeat(other, size)
        spelled = np.repeat(self.start[other] + 1 - (np.cumsum(size[other]) - size[other]), size[other]) + np.arange(int(size[other].sum()))
        self.data[spelled] = letters[of_other]
        piece = np.cumsum(kind == _BREAK)[start]
        last = np.minimum(np.searchsorted(piece, piece, side="right") - 1, np.arange(self.n) + max_words - 1)
        self.end = (self.start + length)[last]

    def strings(self, low: int, high: int) -> pa.Array:
        """These suffixes in code."""
        start = self.start[low:high]
        length = self.end[low:high] - start
        offsets = np.concatenate(([0], np.cumsum(length)))
        at = np.arange(offsets[-1], dtype=np.int64) - np.repeat(offsets[:-1] - start, length)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])

    def written(self) -> Iterator[pa.Array]:
        for low in range(0, self.n, _SLICE):
            yield self.strings(low, min(low + _SLICE, self.n))


def counted(texts: pa.Array, max_words: int, dictionary: Dictionary) -> Iterator[pa.StructArray]:
    """Distinct suffixes of some texts with their numbers; of a very long text, of a stretch of words at a time."""
    held: list[pa.Array] = []
    n = 0
    for part in _runs(texts, PIECE_BYTES):
        for some in Suffixes(part, max_words, dictionary).written():
            held.append(some)
            n += len(some)
            if n >= _COUNTED:
                yield pc.value_counts(pa.chunked_array(held))
                held, n = [], 0
    if held:
        yield pc.value_counts(pa.chunked_array(held))


def _runs(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts in runs of about so many bytes; a longer one is a run of its own."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + size, side="right")))
        yield texts.slice(low, high - low)
        low = high


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each value begins and the last ends."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _beginning_order(column: pa.Array) -> np.ndarray:
    """An order by the first eight bytes: neighbours then begin alike, so that what is sent compresses well."""
    data, offsets = _bytes_of(column)
    key, last = np.zeros(len(column), dtype=np.uint64), max(len(data) - 1, 0)
    for k in range(8):
        at = offsets[:-1] + k
        key = (key << np.uint64(8)) | np.where(at < offsets[1:], data[np.minimum(at, last)], 0).astype(np.uint64)
    return np.argsort(key, kind="stable")


def _hash_prefixes(data: np.ndarray, offsets: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k and row, a hash of its first k words, and where they end; 0 and the row's end where it has fewer."""
    start, stop = offsets[:-1], offsets[1:]
    sums, back = _prefix(data), _power(_BASE_INVERSE, len(data) + 1)[start]
    ends = np.empty((max_words, len(start)), dtype=np.int64)
    hashes = np.zeros((max_words, len(start)), dtype=np.uint64)
    zeros, at = np.flatnonzero(data == 0), start.copy()
    for k in range(max_words):
        more = np.flatnonzero(at < stop)
        here = at[more]
        literal = data[here] == _LITERAL
        end = here + 2
        end[literal] = zeros[np.searchsorted(zeros, here[literal])] + 1
        at[more] = end
        ends[k] = at
        hashes[k, more] = mix((sums[end] - sums[start[more]]) * back[more])
    return hashes, ends


def _hash_codes(codes: Iterable[bytes]) -> np.ndarray:
    """Ascending hashes of whole codes, as `_hash_prefixes` gives them."""
    codes = list(codes)
    end = np.cumsum([len(c) for c in codes], dtype=np.int64)
    return np.sort(_hashes(np.frombuffer(b"".join(codes), dtype=np.uint8), end - [len(c) for c in codes], end)) if codes else np.empty(0, np.uint64)


def _among(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(keys), dtype=bool)
    return ascending[np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)] == keys


def _by_language(batch: pa.RecordBatch, block_bytes: int) -> Iterator[tuple[str, pa.Array]]:
    """The texts of a batch, one language at a time, in runs of about so many bytes."""
    languages = pc.fill_null(batch.column(0), UNKNOWN)
    texts = as_large_string(batch.column(1))
    for language in pc.unique(languages).to_pylist():
        for run in _runs(texts.filter(pc.equal(languages, language)), block_bytes):
            yield language, run


def deals(suffixes: pa.Array, hot: np.ndarray, max_words: int) -> np.ndarray:
    """Of each suffix, a hash of its shortest beginning that is not hot, or of all of it."""
    hashes, _ = _hash_prefixes(*_bytes_of(suffixes), max_words)
    found = hashes[0].copy()
    for k in range(1, max_words):
        further = np.flatnonzero(_among(found, hot) & (hashes[k] != 0) & (found == hashes[k - 1]))
        found[further] = hashes[k, further]
    return (found >> np.uint64(40)).astype(np.int64)


def _suffix_rows(max_words: int, plan: Plan, block_bytes: int):
    """(lang, deal, suffix, n): the distinct suffixes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, hot = plan.dictionary, {x: _hash_codes(codes) for x, codes in plan.hot.items()}
        for batch in batches:
            for language, texts in _by_language(batch, block_bytes):
                own = hot.get(language, _hash_codes(()))
                for counts in counted(texts, max_words, dictionary):
                    counts = counts.take(pa.array(_beginning_order(counts.field(0))))
                    for low in range(0, len(counts), _SLICE):
                        part = counts.slice(low, _SLICE)
                        suffixes = part.field(0).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([language]).take(pa.array(np.zeros(len(part), dtype=np.int64))), pa.array(deals(suffixes, own, max_words)), suffixes, part.field(1).cast(pa.int64())], names=["lang", "deal", "suffix", "n"])
                release_memory()

    return run


class PhraseStack:
    """The phrases of a language that are open, one a length at most, each with its count so far."""

    def __init__(self, max_words: int, least: int, hot: np.ndarray) -> None:
        self.max_words, self.least, self.hot = max_words, least, hot
        self.total = 0
        self.open: list[tuple[bytes, int, bool] | None] = [None] * max_words
        self.closed: list[tuple[bytes | None, int]] = []

    def close(self, phrase: bytes, n: int, hot: bool) -> None:
        if n >= self.least or hot:  # those of hot beginnings are counted in parts, however small
            self.closed.append((phrase, n))

    def end(self) -> None:
        for held in self.open:
            if held:
                self.close(*held)
        self.closed.append((None, self.total))
        self.open, self.total = [None] * self.max_words, 0

    def read(self, suffixes: pa.Array, n: np.ndarray) -> None:
        """Sorted suffixes that go on from those read before."""
        self.total += int(n.sum())
        data, offsets = _bytes_of(suffixes)
        hashes, ends = _hash_prefixes(data, offsets, self.max_words)
        whole = data.tobytes()
        for k in range(self.max_words):
            here = np.flatnonzero(hashes[k])
            held = self.open[k]
            if not len(here):
                if held:
                    self.close(*held)
                    self.open[k] = None
                continue
            # rows of fewer words may stand between, but suffixes that begin with one phrase stand together
            name = hashes[k][here]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            sums, hot = np.add.reduceat(n[here], first), _among(name[first], self.hot)
            low, high = offsets[here[first]], ends[k][here[first]]
            if held:
                if held[0] == whole[low[0] : high[0]]:
                    sums[0] += held[1]
                else:
                    self.close(*held)
            for j in np.flatnonzero((sums[:-1] >= self.least) | hot[:-1]).tolist():
                self.close(whole[low[j] : high[j]], int(sums[j]), True)
            self.open[k] = (whole[low[-1] : high[-1]], int(sums[-1]), bool(hot[-1]))


def _count_sorted(max_words: int, least: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = {x: _hash_codes(codes) for x, codes in plan.hot.items()}
        stacks: dict[str, PhraseStack] = {}

        def take() -> pa.RecordBatch:
            rows = [(language, phrase, n) for language, stack in stacks.items() for phrase, n in stack.closed]
            for stack in stacks.values():
                stack.closed.clear()
            spelled = [None if p is None else b" ".join(plan.dictionary.decode(p)).translate(_BACK).decode() for _, p, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(spelled, pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            which, n = codes.indices.to_numpy(), batch.column(2).to_numpy()
            for k, language in enumerate(codes.dictionary.to_pylist()):
                if language not in stacks:
                    stacks[language] = PhraseStack(max_words, least, hot.get(language, _hash_codes(())))
                mine = np.flatnonzero(which == k)
                stacks[language].read(batch.column(1) if len(mine) == len(n) else batch.column(1).take(pa.array(mine)), n[mine])
            yield take()
        for stack in stacks.values():
            stack.end()
        yield take()
        release_memory()

    return run


class Plan:
    """How suffixes are written and dealt; no count depends on it. hot: per language, beginnings (lists of words) that are dealt further."""

    def __init__(self, words: Iterable[bytes] = (), hot: dict[str, list[list[bytes]]] | None = None) -> None:
        self.dictionary = Dictionary(words)
        self.hot = {language: {self.dictionary.encode(b) for b in beginnings} for language, beginnings in (hot or {}).items()}


def sampled_plan(texts: DataFrame, max_words: int, sample: int = SAMPLE, share: float = HOT_SHARE) -> Plan:
    """From at most about `sample` documents: the most frequent words, and beginnings of at least this share of a language's suffixes; few enough for the driver whatever the input."""
    rows = texts.count()
    some = texts if rows <= sample else texts.sample(sample / rows, seed=13)

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, found = Dictionary(), {}
        for batch in batches:
            for language, part in _by_language(batch, BLOCK_BYTES):
                for k in range(1, max_words):
                    own = found.setdefault((language, k), Counter())
                    for counts in counted(part, k, plain):
                        if k > 1:
                            counts = counts.filter(pc.greater(counts.field(1), int(share * pc.sum(counts.field(1)).as_py() / 4)))
                        own.update({code: n for code, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()) if code.count(0) == k})
        for (language, k), own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(own), pa.string()), pa.array([k] * len(own), pa.int32()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "k", "beginning", "n"])

    counts = cut(some.mapInArrow(beginnings, "lang string, k int, beginning binary, n long").groupBy("lang", "k", "beginning").agg(F.sum("n").alias("n")), "sample")
    words = counts.where("k = 1").groupBy("beginning").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "beginning").limit(Dictionary.SIZE).collect()
    sizes = counts.where("k = 1").groupBy("lang").agg(F.sum("n").alias("words"))
    plain, hot = Dictionary(), {}
    for r in counts.join(sizes, "lang").where(F.col("n") >= share * F.col("words")).select("lang", "beginning").collect():
        hot.setdefault(r["lang"], []).append(plain.decode(bytes(r["beginning"])))
    return Plan([plain.decode(bytes(r["beginning"]))[0] for r in words], hot)


def phrase_counts(texts: DataFrame, max_words: int = 5, least: int = 100, block_bytes: int = BLOCK_BYTES, plan: Plan | None = None) -> DataFrame:
    """(lang, phrase, f): phrases of 1 to max_words words that occur `least` times, and one row a language without a phrase, the number of its words."""
    plan = plan or sampled_plan(texts, max_words)
    rows = texts.mapInArrow(_suffix_rows(max_words, plan, block_bytes), "lang string, deal long, suffix binary, n long")
    dealt = rows.repartition("lang", "deal").select("lang", "suffix", "n").sortWithinPartitions(F.desc("suffix"))
    counted = dealt.mapInArrow(_count_sorted(max_words, least, plan), "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))


def collocations(documents: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000, block_bytes: int = BLOCK_BYTES, plan: Plan | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by the score of their weakest cut."""
    texts = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = cut(phrase_counts(texts, max_words, least, block_bytes, plan), "phrases")
    words = F.split("phrase", " ")
    sizes = cut(counts.where("phrase IS NULL").select("lang", F.col("f").alias("n")), "languages")
    known = counts.where("phrase IS NOT NULL")
    candidates = known.where(F.instr("phrase", " ") > 0).withColumnRenamed("f", "a")

    # f of a phrase one word longer is as large only if every longer one between is
    longer = candidates.withColumn("w", words).where(F.size("w") > 2)
    inner = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("covering"))
    free = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("covering").isNull() | (F.col("covering") < F.col("a"))).select("lang", "phrase", "a")

    cuts = free.withColumn("w", words).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left, right = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    a, n, l, r = (f"cast({c} as decimal(19,0))" for c in "anlr")  # products of 38 digits
    scored = cuts.withColumn("score", F.expr(f"(1000 * ({a} * {n})) div ({l} * {r})"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
