"""Mixing sources to target weights, by DataFrame functions alone.

A classifier fitted on a labelled table gives every document a soft membership in each domain: a
naive Bayes model over hashed lower-case words, whose evidence is tempered to that of
EVIDENCE_WORDS words so that posteriors stay soft. The expected tokens of a domain are the sum of
a document's words times its posterior. Document rates (how often a document is to be seen) are
then fitted by projected gradient least squares so that the expected domain totals match targets, as close to
the rate 1 as these allow: each step moves every rate against the errors of the totals, weighed by its posterior,
and projects the sum of its moves on rates of `min_rate` or more. Steps are scaled by the inverse second moments of
the posteriors, over the rates that the bound leaves free, so that a step without projection meets the targets at once.
The moves are one number a domain, so the rates of all documents are known from these few.

By default no rate is below 1, so that nothing is lost to mixing, and the total is the least found,
in steps of GROWTH, at which the wanted proportions can be met under that bound. The fit goes on
until the largest error of a domain is TOLERANCE of the total. Targets that no rates meet are
reported, never missed silently: `residual` is that error, a warning is given, and rates stay at 1
(the closest rates, where a total was asked for).

The steps are rehearsed on cells: documents of nearly equal posteriors, at most CELLS of them, with their tokens and
the tokens' posteriors summed, which the driver fits by the same steps. Every document starts from the moves found
there, by its own posterior, and further steps over all documents end the fit exactly. So a few passes read the
documents, not some dozens.

Scale: fitting reads at most `max_labelled` labelled rows, the least by hash, and gives domains x
BUCKETS numbers. Posteriors are one narrow pass over the texts inside the JVM, without exchange or
exploded words; `mixed_documents` writes them beside the rows, so texts are scored once. Steps read
a table of 8 x (2 + domains) bytes a row, once each, and exchange one row a task. Only domain totals, moments and
cells (CELLS rows at most, whatever the input) reach the driver.

Cases: null and empty texts have no words; their posterior is the prior, their rate does not
matter to the totals. Rows of a repeated or null doc_id are rated each by its text. An empty table
gives no rows. Domains without labelled rows, or without tokens, cannot be told or mixed in: their
targets are dropped and the others keep their proportions (their posteriors are 0); with fewer
than two domains left all rates are 1. Extra columns are ignored;
`mixed_documents` returns all columns.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut

BUCKETS = 1 << 13
MAX_LABELLED = 20_000
EVIDENCE_WORDS = 20.0
TOLERANCE = 1e-5
GROWTH = 1.2
STALLED_STEPS = 3
MAX_STEPS = 60
CELLS = 1 << 16
CELL_STEPS = 2_000
MAX_GROWTH = 32.0


@dataclass
class Fit:
    """targets and reached totals by domain, the largest error as a part of the total, and steps taken."""

    targets: list[float]
    reached: list[float]
    residual: float
    steps: int

    @property
    def met(self) -> bool:
        return self.residual <= TOLERANCE


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word of the lower-cased text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_classifier(documents: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, text_col: str = "text") -> tuple[list[float], list[list[float]]]:
    """Log prior and log bucket probabilities of each domain; minus infinity is the prior of one without labelled rows, if others have some. labelled: doc_id, domain; documents join it by doc_id."""
    sample = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("domain", word_buckets(F.col("text"), buckets).alias("words"))
    n_rows = dict(tuple(r) for r in rows.groupBy("domain").count().collect())
    counts = {d: [1.0] * buckets for d in domains}
    for domain, bucket, n in rows.select("domain", F.explode("words").alias("bucket")).groupBy("domain", "bucket").count().collect():
        counts[domain][bucket] += n
    prior = [math.log((n_rows.get(d, 0) + 1) / (sum(n_rows.values()) + len(domains))) if not n_rows or d in n_rows else -math.inf for d in domains]
    return prior, [[math.log(c / sum(counts[d])) for c in counts[d]] for d in domains]


def posteriors(documents: DataFrame, model: tuple[list[float], list[list[float]]], keep: list[str], evidence: float = EVIDENCE_WORDS, text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens, and the posterior of each domain as an array."""
    prior, weights = model
    buckets = len(weights[0])
    worded = documents.select(*keep, word_buckets(F.col(text_col), buckets).alias("\twords"))
    n = F.size("\twords")
    strength = F.least(F.lit(1.0), F.lit(evidence) / F.greatest(n, F.lit(1)))

    def evidence_of(w: list[float]) -> Column:
        table = F.lit(np.array(w, dtype=np.float64))  # one literal, not an expression a bucket
        return F.aggregate("\twords", F.lit(0.0), lambda total, b: total + F.get(table, b))

    scored = worded.select(*keep, n.cast("long").alias("n_tokens"), F.array(*[F.lit(p) + strength * evidence_of(w) for p, w in zip(prior, weights)]).alias("\tscores"))
    raised = F.transform("\tscores", lambda s: F.exp(s - F.array_max("\tscores")))
    powered = scored.select(*keep, "n_tokens", raised.alias("\traised"))
    total = F.aggregate("\traised", F.lit(0.0), lambda a, x: a + x)
    return powered.select(*keep, "n_tokens", total.alias("\ttotal"), "\traised").select(*keep, "n_tokens", F.transform("\traised", lambda x: x / F.col("\ttotal")).alias("posterior"))


def _levels(k: int) -> int:
    """Steps a posterior is cut into, so that k domains have CELLS cells at most; the last domain's follows from the others."""
    return max(1, int(CELLS ** (1 / max(k - 1, 1)) + 1e-9))


def cell_of(k: int) -> Column:
    levels = _levels(k)
    places = [F.least(F.floor(F.get("posterior", F.lit(d)) * levels), F.lit(levels - 1)) * levels**d for d in range(k - 1)] if levels > 1 else []
    return sum(places, F.lit(0)).cast("int")


class Cells:
    """Documents by cell, fitted on the driver: tokens, and the mean posterior of a cell's tokens."""

    def __init__(self, rows: list, k: int) -> None:
        tokens = np.array([float(r["tokens"] or 0) for r in rows])
        self.sums = np.array([[float(r[f"s{d}"] or 0) for d in range(k)] for r in rows]).reshape(len(rows), k)
        self.p = self.sums / np.maximum(tokens, 1.0)[:, None]

    def totals(self, moves: np.ndarray, one: float, min_rate: float) -> tuple[np.ndarray, np.ndarray]:
        rate = np.maximum(min_rate, one - self.p @ moves)
        return rate @ self.sums, (self.sums * (rate > min_rate)[:, None]).T @ self.p


class Documents:
    """The table itself; `totals` is one pass over it."""

    def __init__(self, table: DataFrame, k: int) -> None:
        self.table, self.tokens, self.p = table, F.col("n_tokens").cast("double"), [F.get("posterior", F.lit(d)) for d in range(k)]

    def rate(self, moves: np.ndarray, one: float, min_rate: float) -> Column:
        return F.greatest(F.lit(float(min_rate)), F.lit(float(one)) - sum((F.lit(float(x)) * p for x, p in zip(moves, self.p)), F.lit(0.0)))

    def totals(self, moves: np.ndarray, one: float, min_rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by domain, and second moments of the posteriors over rates that the bound leaves free."""
        k, rate = len(self.p), self.rate(moves, one, min_rate)
        upper = [(a, b) for a in range(k) for b in range(a, k)]
        columns = [rate * self.tokens * x for x in self.p] + [F.when(rate > min_rate, self.tokens).otherwise(0.0) * self.p[a] * self.p[b] for a, b in upper]
        row = [float(x) for x in self.table.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in columns]).first()]
        out = np.zeros((k, k))
        for (a, b), x in zip(upper, row[k:]):
            out[a, b] = out[b, a] = x
        return np.array(row[:k]), out


def _descend(rated: Cells | Documents, moves: np.ndarray, one: float, share: np.ndarray, every: np.ndarray, aim: float, may_grow: bool, min_rate: float, tolerance: float, max_steps: int) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Projected gradient steps until the totals are the aim's shares; the moves, the aim (grown, where it may), the totals reached, and steps."""
    first_aim, against_all, errors = aim, np.linalg.pinv(every, rcond=1e-12), []
    reached, free = rated.totals(moves, one, min_rate)
    for steps in range(max_steps + 1):
        error = reached - aim * share
        if float(np.abs(error).max()) <= tolerance * aim or steps == max_steps:
            break
        worth, fresh = float(error @ against_all @ error), not errors
        if may_grow and len(errors) >= STALLED_STEPS and worth > 0.25 * errors[-STALLED_STEPS]:
            if aim * GROWTH > MAX_GROWTH * first_aim:
                break
            aim, errors, fresh = aim * GROWTH, [], True  # more tokens leave the bound less to forbid
            error = reached - aim * share
            worth = float(error @ against_all @ error)
        # the moments of free rates hasten the end; where they did not help, those of all
        scale = free if fresh or worth < 0.9 * errors[-1] else every
        errors.append(worth)
        moves = moves + np.linalg.pinv(scale + 1e-6 * every, rcond=1e-12) @ error
        reached, free = rated.totals(moves, one, min_rate)
    return moves, aim, reached, steps


def fit_rates(table: DataFrame, weights: list[float], total_tokens: float | None = None, min_rate: float = 1.0, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> tuple[DataFrame, Fit]:
    """The table (n_tokens, posterior and other columns) with `rate`, and how the fit ended; its steps are those over the documents."""
    k, one = len(weights), max(1.0, min_rate)
    tokens = F.col("n_tokens").cast("double")
    summed = [F.sum(tokens).alias("tokens"), *(F.sum(tokens * F.get("posterior", F.lit(d))).alias(f"s{d}") for d in range(k))]
    cells = Cells(table.groupBy(cell_of(k).alias("cell")).agg(*summed).collect(), k)  # at most CELLS rows
    natural, every = cells.sums.sum(axis=0), cells.sums.T @ cells.p
    share = np.where(natural > 0, np.array(weights, dtype=float), 0.0)
    if (share > 0).sum() < 2 and total_tokens is None:
        return table.withColumn("rate", F.lit(one)), Fit((natural * (share > 0)).tolist(), natural.tolist(), 0.0, 0)
    share /= share.sum() or 1.0
    aim = total_tokens if total_tokens is not None else max(float(n / s) for n, s in zip(natural, share) if s > 0)
    may_grow = total_tokens is None
    if may_grow and np.abs(natural - aim * share).max() > tolerance * aim:
        aim = 1.02 * aim
    first_aim, none = aim, np.zeros(k)
    moves, aim, reached, _ = _descend(cells, none, one, share, every, aim, may_grow, min_rate, tolerance / 10, CELL_STEPS)
    if np.abs(reached - aim * share).max() > 0.01 * aim:
        moves, aim = none, first_aim  # cells do not tell; the documents decide
    documents = Documents(table, k)
    moves, aim, reached, steps = _descend(documents, moves, one, share, every, aim, may_grow, min_rate, tolerance, max_steps)
    rate = documents.rate(moves, one, min_rate)
    fit = Fit((aim * share).tolist(), reached.tolist(), float(np.abs(reached - aim * share).max() / aim) if aim else 0.0, steps)
    if fit.residual > tolerance:
        warnings.warn(f"targets {fit.targets} are missed by {fit.residual:.3g} of their total; reached {fit.reached}", stacklevel=2)
        if may_grow:
            rate = F.lit(one)
    return table.withColumn("rate", rate), fit


def copies_of(rate: Column, key: Column) -> Column:
    """A whole number of copies with the rate as its mean: the fraction is decided by a hash of the key."""
    chance = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / F.lit(1e6)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None, total_tokens: float | None = None, min_rate: float | None = None, max_labelled: int = MAX_LABELLED, text_col: str = "text") -> DataFrame:
    """The kept columns (doc_id by default), n_tokens, domain (the likeliest), posterior, rate, copies, residual (of the fit). With `total_tokens` rates can go down to 0."""
    keep, domains = keep or ["doc_id"], list(targets)
    model = fit_classifier(documents, labelled, domains, max_labelled=max_labelled, text_col=text_col)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"), F.xxhash64("doc_id", text_col).alias("key"))
    table = cut(posteriors(rows, model, ["row", "key"]), "posteriors")
    bound = min_rate if min_rate is not None else 1.0 if total_tokens is None else 0.0
    rated, fit = fit_rates(table, list(targets.values()), total_tokens, bound)
    likeliest = F.get(F.lit(domains), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return rated.select("row.*", "n_tokens", likeliest.alias("domain"), "posterior", "rate", copies_of(F.col("rate"), F.col("key")).alias("copies"), F.lit(fit.residual).alias("residual"))


def mixed_with_fit(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], max_labelled: int = MAX_LABELLED, text_col: str = "text") -> tuple[DataFrame, Fit]:
    """All columns of the documents, each row as often as its copies say; and how the fit ended."""
    model = fit_classifier(documents, labelled, list(targets), max_labelled=max_labelled, text_col=text_col)
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"), F.xxhash64("doc_id", text_col).alias("key"))
    rated, fit = fit_rates(cut(posteriors(rows, model, ["row", "key"]), "posteriors"), list(targets.values()))
    copies = copies_of(F.col("rate"), F.col("key")).cast("int")
    return rated.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*"), fit


def mixed_documents(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], max_labelled: int = MAX_LABELLED, text_col: str = "text") -> DataFrame:
    return mixed_with_fit(documents, labelled, targets, max_labelled, text_col)[0]
