"""LM scoring: log probabilities of whole texts under a weighted backoff automaton of n-grams up to three words.

States are contexts seen in training: the root, one state a word, one a word pair. An arc reads a
word that followed the context in training, with the smoothed probability
(count + m * lower) / (context + m), `lower` being the probability in the shorter context, and leads
to the state of the longest seen suffix. Where a state has no arc for a word, its failure arc, of
weight m / (context + m), leads to the state of the context without its first word, and the word is
tried again there. The root reads every word: one seen c times with (c - d) / N, and words never
seen together, as one unknown word, with the mass that the discount d frees; d is the Good-Turing
value n1 / (n1 + 2 * n2). Each state's probabilities sum to one over the training words, the end and
the unknown word, the events of the base score. m is weight * context ** power + 1, by order.

A text is read from left to right from the state of a text's end. The state is carried from token
to token and failure arcs are followed one by one; many stretches of text step together as arrays.
A state is known from the two tokens before it, so a stretch inside a text reads these first, from
the root, without scoring them, and long texts cost no more steps than short ones.

Scale: the automaton grows with the corpus and is never in one place; see block_counts. Documents
are packed into blocks as they come, and written once; a block's counts of words, pairs and triples
give the part of the automaton that its texts can reach. Exchanged: the compressed text once, and
per block and distinct n-gram about 3 bytes there and 1 back. The driver sees four sums.

Words have 64-bit hashes; keys of pairs and triples have as many bits as leave 2 ** SPARE_BITS keys
to a training token, so one pair or triple in 10,000 takes another's count.

Cases: null and empty texts are the end token alone. A null doc_id trains. Repeated rows train and
are scored each. An empty table gives no rows. Extra columns are ignored. Without training tokens
both scores are 0 for every text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import block_counts as bc
from paperloom.llm.shared import cut
from paperloom.llm.words import as_large_string, blocks, mix, release_memory

SPARE_BITS = 14
#: Text of a block; half of what counting alone would take, as a block's automaton and its counts are in memory together.
BLOCK_BYTES = 4 << 20
#: m of word states and of pair states: weight and power of the context's count.
Smoothing = tuple[tuple[float, float], tuple[float, float]]
SMOOTHING: Smoothing = ((10.0, 0.7), (2.0, 0.5))
STRETCH = 256
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END = np.uint64(0xE5D0_0000_0000_0001)
_KINDS = {"words": 1, "pairs": 1, "triples": 1}
_SUMS = ("n_types", "n_tokens", "n_once", "n_twice")


def held_out(doc_ids: list[int | None], modulus: int = 7, remainder: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % modulus == remainder for d in doc_ids], dtype=bool)


@dataclass
class Tokens:
    """The tokens of some texts. Distinct keys ascend."""

    sizes: np.ndarray  # tokens of each text
    words: np.ndarray
    word_of: np.ndarray  # per token, its place in words
    pairs: np.ndarray
    pair_of: np.ndarray  # per token, the pair that it ends; before a text stands an end
    triples: np.ndarray
    triple_of: np.ndarray  # per token; not of the first in a text


def tokens_of(texts: pa.Array | pa.ChunkedArray, bits: int) -> Tokens:
    tokens, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, block in blocks(texts):
        hashes, n = block.word_hashes(lower=True), block.n_words
        part = np.full(len(hashes) + len(n), _END, dtype=np.uint64)
        part[np.arange(len(hashes)) + block.row_of_word()] = hashes
        tokens.append(part)
        sizes.append(n + 1)
    token, n_tokens = np.concatenate(tokens), np.concatenate(sizes)
    shift = np.uint64(64 - bits)
    pair = mix(np.concatenate(([_END], token[:-1])) * np.uint64(3) + token)
    triple = mix(np.concatenate(([_END], pair[:-1])) * np.uint64(5) + token) >> shift
    words, word_of = np.unique(token, return_inverse=True)
    pairs, pair_of = np.unique(pair >> shift, return_inverse=True)
    inner = np.ones(len(token), dtype=bool)
    inner[np.cumsum(n_tokens) - n_tokens] = False
    triples, found = np.unique(triple[inner], return_inverse=True)
    triple_of = np.full(len(token), -1, dtype=np.int64)
    triple_of[inner] = found
    return Tokens(n_tokens, words, word_of, pairs, pair_of, triples, triple_of)


def training_counts(t: Tokens, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, pair and triple, how often it stands in training texts."""
    counted = np.repeat(training, t.sizes)
    inner = counted & (t.triple_of >= 0)
    return tuple(np.bincount(x, minlength=len(k)) for x, k in ((t.word_of[counted], t.words), (t.pair_of[counted], t.pairs), (t.triple_of[inner], t.triples)))


def _grams(bits: int):
    def run(table: pa.Table) -> bc.Grams:
        t = tokens_of(as_large_string(table["text"]), bits)
        words, pairs, triples = training_counts(t, ~held_out(table["doc_id"].to_pylist()))
        return {"words": (t.words, 64, [words]), "pairs": (t.pairs, bits, [pairs]), "triples": (t.triples, bits, [triples])}

    return run


def _sums(totals: dict[str, list[np.ndarray]]) -> list[int]:
    x = totals["words"][0]
    return [(x > 0).sum(), x.sum(), (x == 1).sum(), (x == 2).sum()]


@dataclass
class Totals:
    """Of the training tokens: distinct ones, all, those seen once, those seen twice."""

    n_types: int
    n_tokens: int
    n_once: int
    n_twice: int


class Automaton:
    """The part of the automaton that some tokens can reach. State 0 is the root, then words, then pairs."""

    def __init__(self, t: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, totals: Totals, smoothing: Smoothing = SMOOTHING) -> None:
        n_words = len(t.words)
        discount = min(max(totals.n_once / max(totals.n_once + 2 * totals.n_twice, 1), 0.1), 0.9)
        root = np.where(words > 0, words - discount, discount * totals.n_types) / totals.n_tokens
        first, last = self._ends_of_pairs(t)
        context = [words.astype(np.float64), pairs.astype(np.float64)]
        extra = [weight * c**power + 1 for c, (weight, power) in zip(context, smoothing)]
        self.n_labels = n_words
        # states of contexts never seen in training are not reached
        self.failure = np.concatenate(([0], np.zeros(n_words, np.int64), 1 + last))
        self.failure_log = np.log10(np.concatenate(([1.0], *(m / (c + m) for m, c in zip(extra, context)))))
        word_state, pair_state = np.where(words > 0, 1 + np.arange(n_words), 0), 1 + n_words + np.arange(len(pairs))
        pair_target = np.where(pairs > 0, pair_state, word_state[last])
        # arcs: (state, label) -> next state, log probability; the root has one for every label
        in_word = (pairs + extra[0][first] * root[last]) / (context[0][first] + extra[0][first])
        before, of_triple = self._parts_of_triples(t)
        seen, known = pairs > 0, triples > 0
        in_pair = (triples + extra[1][before] * in_word[of_triple]) / (context[1][before] + extra[1][before])
        keys = np.concatenate((np.arange(n_words), (1 + first[seen]) * n_words + last[seen], (1 + n_words + before[known]) * n_words + last[of_triple[known]]))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.target = np.concatenate((word_state, pair_target[seen], pair_target[of_triple[known]]))[order]
        self.arc_log = np.log10(np.concatenate((root, in_word[seen], in_pair[known])))[order]
        at = np.searchsorted(t.words, _END)
        self.start = int(word_state[at]) if at < n_words and t.words[at] == _END else 0

    @staticmethod
    def _ends_of_pairs(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The words of each pair."""
        first, last = np.zeros(len(t.pairs), dtype=np.int64), np.zeros(len(t.pairs), dtype=np.int64)
        end = np.searchsorted(t.words, _END)
        first[t.pair_of] = np.concatenate(([end], t.word_of[:-1]))
        last[t.pair_of] = t.word_of
        return first, last

    @staticmethod
    def _parts_of_triples(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The pair that each triple begins with, and the one that it ends with."""
        before, after = np.zeros(len(t.triples), dtype=np.int64), np.zeros(len(t.triples), dtype=np.int64)
        inner = np.flatnonzero(t.triple_of >= 0)
        before[t.triple_of[inner]] = t.pair_of[inner - 1]
        after[t.triple_of[inner]] = t.pair_of[inner]
        return before, after

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities; failure arcs are followed until a state has an arc."""
        state, log = state.copy(), np.zeros(len(state))
        out, left = np.empty(len(state), dtype=np.int64), np.arange(len(state))
        while len(left):
            key = state[left] * self.n_labels + label[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[left[found]] = self.target[at[found]]
            log[left[found]] += self.arc_log[at[found]]
            left = left[~found]
            log[left] += self.failure_log[state[left]]
            state[left] = self.failure[state[left]]
        return out, log

    def traverse(self, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Log10 probability of each token of texts that stand one after another."""
        out = np.zeros(len(labels))
        ends = np.cumsum(sizes)
        n = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), n)
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        low = (ends - sizes)[owner] + place
        high = np.minimum(low + STRETCH, ends[owner])
        order = np.argsort(low - high, kind="stable")  # longest first, so that those that go on stand in front
        low, high, inside = low[order], high[order], place[order] > 0
        state = np.where(inside, 0, self.start)
        for back in (2, 1):
            state[inside], _ = self.step(state[inside], labels[low[inside] - back])
        lengths = high - low
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            at = low[:active] + step
            state[:active], out[at] = self.step(state[:active], labels[at])
        return out


def _score(totals: Totals, bits: int, smoothing: Smoothing):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = bc.open_block(left["rows"][0])
        ids = table["doc_id"].to_pylist()
        t = tokens_of(as_large_string(table["text"]), bits)
        words, pairs, triples = (x for (x,) in bc.totals_of(right, _KINDS).values())
        logs = Automaton(t, words, pairs, triples, totals, smoothing).traverse(t.sizes, t.word_of) if totals.n_tokens else np.zeros(len(t.word_of))
        first = np.cumsum(t.sizes) - t.sizes
        count = words[t.word_of]
        base = np.add.reduceat(np.log10((count + 1) / (totals.n_tokens + totals.n_types + 1)), first)
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        columns = [pa.array(ids, pa.int64()), held_out(ids), t.sizes, known, np.full(len(ids), totals.n_tokens), base, np.add.reduceat(logs, first)]
        del t, words, pairs, triples, logs, count, table
        release_memory()
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def lm_scores(documents: DataFrame, block_bytes: int | None = None, range_bytes: int | None = None, most_ranges: int = bc.MOST_RANGES, smoothing: Smoothing = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCHEMA for every document; those that are not held out train."""
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = documents.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    block_bytes, range_bytes = bc.sizes(documents.sparkSession, size, block_bytes, range_bytes, BLOCK_BYTES)
    bits = bc.key_bits(size, SPARE_BITS - 2)  # a token has four bytes or more, as a rule
    packed = cut(bc.pack_blocks(documents, block_bytes), "blocks")
    asks = lambda ranges: bc.asked(packed, _grams(bits), _KINDS, ranges)
    replies, sums = bc.totalled(asks, bc.n_ranges(size, range_bytes), bc.n_ranges(size, block_bytes), {"words": 64, "pairs": bits, "triples": bits}, _KINDS, _sums, _SUMS, most_ranges)
    totals = Totals(*sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _SUMS]).first())
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(totals, bits, smoothing), SCHEMA)
