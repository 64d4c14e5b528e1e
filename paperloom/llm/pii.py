"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Kinds: email, ip, card, phone. The base is a fixed pattern for each kind, matched leftmost and
without overlaps; matches that fail their check (address parts, card checksum, digit counts) are
dropped and not retried, so an entity next to other digits can be lost. The model finds those, and
written-out forms ("name [at] host [dot] org"): candidate segments are scored as wholes (shape,
checksum, digit groups, neighbours on both sides), and a dynamic programme over segments of at
most MAX_UNITS units and MAX_CHARS characters, the method's bounds on an entity, picks boundaries
and kinds jointly. Its spans are added where they touch no base span; base spans stay.

The model is trained on lines generated by `training_lines`, with entities in many forms, next to
one another and among things that look like them (keys, versions, dates, failing checksums).
A text stands between two units outside entities. Entities can begin only in zones: runs of digits
and digit punctuation, or words around an at sign or its written-out form. Units that no candidate
covers are outside in every segmentation, so the runs of units that candidates cover, each between
two such units, are decoded alone with the moves in and out charged: the same answer as decoding
the whole text.

Scale: one narrow pass; the model is some hundred numbers in the task closure. Work per text is
linear, whatever it holds: patterns read a run of their characters once, and a unit begins at most
MAX_UNITS candidates, which are looked at only if their digits can make an entity.

Fixed by the kinds, not by cost: an address by numbers has 7 characters or more, a card 16 to 19
digits, a phone number 7 (without country) to 15, in at most MAX_GROUPS groups with at most one pair
of parentheses and one plus sign; the local part of a mail address has at most 64
characters and its whole 254 (RFC 5321). Longer runs are no entities to the model; the base finds
mail addresses of any length.

Cases: null and empty texts have no spans. Texts are whole. Offsets are code points, ends exclusive.
Repeated rows and null ids give repeated results. An empty table gives no rows. Extra columns are
ignored unless kept.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_UNITS = 28
MAX_CHARS = 254
MIN_DIGITS, MAX_DIGITS, MAX_GROUPS = 7, 19, 8
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # kind, start, end

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match can begin only where a run of digits does
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = r"[\[(]\s?at\s?[\])]"
_DOT = r"[\[(]\s?dot\s?[\])]"
_WRITTEN = re.compile(rf"[\w.+-]{{1,64}}\s?{_AT}\s?[\w-]{{1,63}}(?:\s?(?:\.|{_DOT})\s?[\w-]{{1,63}})+", re.I)
_AT_SIGN = re.compile(_AT, re.I)
_AFTER_AT = re.compile(rf"\s?[\w-]{{1,63}}(?:\s?(?:\.|{_DOT})\s?[\w-]{{1,63}})+", re.I)
_BEFORE_AT = re.compile(r"[\w.+-]{1,64}\s?\Z")
_RUN = re.compile(r"[0-9\x20().+/-]{2,}")
_FIRST = re.compile(r"[0-9+(]")
_SPACELESS = re.compile(r"\S*")
_UNIT = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The base matches in the order of kinds, then starts."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # a match ends its local part at this sign; its start is the farthest that the characters before allow
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at and (m := _EMAIL.match(text, begin)):
            out.append((0, m.start(), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _valid_ip(m[0])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Where entities can be: sorted, disjoint."""
    found: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):  # from the first character that can begin a number to the last digit
            run = m[0].rstrip(" ().+/-")
            if (first := _FIRST.search(run)) and len(run) - first.start() >= 7:
                found.append((m.start() + first.start(), m.start() + len(run)))
    at = text.find("@")
    while at >= 0:
        a = at - len(text[max(0, at - MAX_CHARS) : at].split()[-1]) if at and not text[at - 1].isspace() else at
        b = _SPACELESS.match(text, at, at + MAX_CHARS).end()
        found.append((a, b))
        at = text.find("@", max(b, at + 1))
    if "[" in text or "(" in text:
        for m in _AT_SIGN.finditer(text):
            before, after = _BEFORE_AT.search(text[max(0, m.start() - 65) : m.start()]), _AFTER_AT.match(text, m.end())
            if before and after:
                found.append((m.start() - len(before[0]), after.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def units(text: str, a: int, b: int) -> list[int]:
    """Unit boundaries of a zone, ends included."""
    return [a, *(m.end() for m in _UNIT.finditer(text, a, b))]


def _side(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in ".-+@(/_" else "other"


def segment_features(text: str, a: int, b: int) -> tuple[list[str], tuple[int, ...]] | None:
    """Features of text[a:b] as one segment, and the kinds that it can be; None if none."""
    span = text[a:b]
    digits = _digits(span)
    names = [f"left={_side(text[a - 1 : a])}", f"right={_side(text[b : b + 1])}"]
    if text[b : b + 1] in (".", "-", "@", "/") and (after := text[b + 1 : b + 2]) and after.isalnum():
        names.append("right goes on")
    if a > 1 and text[a - 1] in ".-/" and text[a - 2].isalnum():
        names.append("left goes on")
    if "@" in span or "[" in span or re.search(_AT, span, re.I):
        if not (span[-1].isalnum() and (span[0].isalnum() or span[0] in "._%+-")):
            return None
        plain, written = _EMAIL.fullmatch(span), _WRITTEN.fullmatch(span)
        last = re.split(r"[^A-Za-z]", span)[-1]
        names += ["plain address" if plain else "written address" if written else "no address", f"signs={min(span.count('@'), 2)}", f"ending={min(len(last), 4)}"]
        names.append("space inside" if any(c.isspace() for c in span) and not written else "no space inside")
        return names, (0,)
    if any(not (c.isdigit() or c in " ().+/-") for c in span) or not span[-1].isdigit() or not (span[0].isdigit() or span[0] in "+("):
        return None
    groups = re.findall(r"[0-9]+", span)
    marks = set(re.sub(r"[0-9]", "", span))
    if len(groups) == 4 and span.count(".") == 3 and marks == {"."}:
        names += ["four parts", "parts in range" if _valid_ip(span) else "parts too large"]
    elif not MIN_DIGITS <= len(digits) <= MAX_DIGITS:
        return None
    n = len(digits)
    names += [f"digits={n if n < 20 else 20}", f"groups={'-'.join(str(len(g)) for g in groups)}" if len(groups) <= 6 else "groups=many", f"n groups={min(len(groups), 6)}"]
    if n >= 15:
        names.append(f"checksum={luhn(digits)}")
        if n == 16 and {len(g) for g in groups} <= {4, 16} and marks <= {" ", "-"}:
            names.append(f"card groups, checksum={luhn(digits)}")
    names.append("plus first" if span[0] == "+" else "plus inside" if "+" in span else "no plus")
    depth_ok = span.count("(") == span.count(")") <= 1 and span.find("(") <= span.find(")")
    names += [f"paren={'none' if '(' not in span and ')' not in span else depth_ok}", f"marks={''.join(sorted(marks - set('+()')))[:4]}"]
    if re.search(r"[ .-]{2}", span):
        names.append("marks meet")
    return names, (1, 2, 3)


class SegmentModel:
    """Weights of a semi-Markov conditional random field; label 0 is a unit outside, label k + 1 a segment of kind k."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, int], float] = {}
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def candidates(self, text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
        """Unit boundaries, and (first unit, last unit + 1, kind, features) of each segment that can be an entity."""
        cuts = units(text, a, b)
        n = len(cuts) - 1
        digits, groups, marks, signs, others = [0], [0], [0], [0], [0]  # before each unit: digits, runs of them, signs of phone numbers, of mail addresses, and units that no number has
        for i in range(n):
            c, size = text[cuts[i]], cuts[i + 1] - cuts[i]
            is_digit = "0" <= c <= "9"
            digits.append(digits[-1] + size * is_digit)
            groups.append(groups[-1] + is_digit)
            marks.append(marks[-1] + (c in "(+"))
            signs.append(signs[-1] + (c in "@[("))
            others.append(others[-1] + (c not in "0123456789 ().+/-" and not c.isdigit()))
        out = []
        for i in range(n):
            if not ((c := text[cuts[i]]).isalnum() or c in "._%+-("):
                continue
            for j in range(i + 1, min(i + MAX_UNITS, n) + 1):
                size = cuts[j] - cuts[i]
                if size > MAX_CHARS:
                    break
                if size < 5 or not text[cuts[j] - 1].isalnum():
                    continue
                n_digits = digits[j] - digits[i]
                plain = others[j] == others[i]
                if plain and (n_digits > MAX_DIGITS or groups[j] - groups[i] > MAX_GROUPS or marks[j] - marks[i] > 2):
                    if signs[n] == signs[i]:
                        break
                    continue
                parts = n_digits < MIN_DIGITS and text.count(".", cuts[i], cuts[j]) == 3
                if not (plain and size >= 7 and (n_digits >= MIN_DIGITS or parts)) and signs[j] == signs[i]:
                    continue
                if found := segment_features(text, cuts[i], cuts[j]):
                    out += [(i, j, kind, found[0]) for kind in found[1]]
        return cuts, out

    def score(self, kind: int, names: list[str]) -> float:
        get = self.weights.get
        return get(("bias", kind), 0.0) + sum(get((n, kind), 0.0) for n in names)

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a zone, run by run of units that candidates cover."""
        cuts, segments = self.candidates(text, a, b)
        out: list[Span] = []
        low = 0
        while low < len(segments):  # in the order of their first units
            high, end = low, segments[low][1]
            while high < len(segments) and segments[high][0] <= end:  # one that begins at an end follows without a unit between
                end = max(end, segments[high][1])
                high += 1
            out += self._decode_run(cuts, segments[low:high], segments[low][0], end)
            low = high
        return out

    def _decode_run(self, cuts: list[int], segments: list[tuple[int, int, int, list[str]]], first: int, last: int) -> list[Span]:
        n, labels = last - first, len(KINDS) + 1
        ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i, j, kind, names in segments:
            ending[j - first].append((i - first, kind + 1, self.score(kind, names)))
        moves = self.moves.tolist()
        best = [[-math.inf] * labels for _ in range(n + 1)]
        back: list[list[tuple[int, int] | None]] = [[None] * labels for _ in range(n + 1)]
        best[0][0] = 0.0
        for j in range(1, n + 1):
            for i, y, s in [(j - 1, 0, 0.0), *ending[j]]:
                worth, k = max((best[i][x] + moves[x][y], -x) for x in range(labels))
                if worth + s > best[j][y]:
                    best[j][y], back[j][y] = worth + s, (i, -k)
        # the unit after a run is outside
        j, y, out = n, max(range(labels), key=lambda x: (best[n][x] + moves[x][0], -x)), []
        while j > 0:
            i, k = back[j][y]
            if y:
                out.append((y - 1, cuts[first + i], cuts[first + j]))
            j, y = i, k
        return out[::-1]

    def fit(self, lines: list[tuple[str, list[Span]]], rounds: int = 10, rate: float = 0.5, penalty: float = 1e-3) -> SegmentModel:
        """Maximum likelihood by adaptive gradient steps; expectations by forward and backward sums over segments."""
        tasks = []
        for text, truth in lines:
            for a, b in zones(text):
                cuts, segments = self.candidates(text, a, b)
                if segments:
                    at = {c: k for k, c in enumerate(cuts)}
                    possible = {s[:3] for s in segments}
                    gold = {g for k, s, e in truth if s in at and e in at and (g := (at[s], at[e], k)) in possible}
                    tasks.append((len(cuts) - 1, segments, gold))
        index: dict[tuple[str, int], int] = {}
        for _, segments, _ in tasks:
            for _, _, kind, names in segments:
                for name in ("bias", *names):
                    index.setdefault((name, kind), len(index))
        ids = [[np.array([index[(n, s[2])] for n in ("bias", *s[3])]) for s in segments] for _, segments, _ in tasks]
        labels = len(KINDS) + 1
        w, m = np.zeros(len(index)), np.zeros((labels, labels))
        w_seen, m_seen = np.full(len(index), 1e-2), np.full((labels, labels), 1e-2)
        for _ in range(rounds):
            for (n, segments, gold), own in zip(tasks, ids):
                scores = [w[x].sum() for x in own]
                ending: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
                for k, (i, j, kind, _) in enumerate(segments):
                    ending[j].append((i, kind + 1, k))
                for j in range(1, n + 1):
                    ending[j].append((j - 1, 0, -1))
                forward, backward = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
                forward[0, 0], backward[n] = 0, m[:, 0]  # the unit after a zone is outside
                for j in range(1, n + 1):
                    for i, y, k in ending[j]:
                        forward[j, y] = np.logaddexp(forward[j, y], np.logaddexp.reduce(forward[i] + m[:, y]) + (scores[k] if k >= 0 else 0.0))
                for j in range(n, 0, -1):
                    for i, y, k in ending[j]:
                        backward[i] = np.logaddexp(backward[i], m[:, y] + (scores[k] if k >= 0 else 0.0) + backward[j, y])
                total = np.logaddexp.reduce(forward[n] + m[:, 0])
                dw, dm = np.zeros(len(index)), np.zeros((labels, labels))
                dm[:, 0] -= np.exp(forward[n] + m[:, 0] - total)
                for j in range(1, n + 1):
                    for i, y, k in ending[j]:
                        p = np.exp(forward[i] + m[:, y] + (scores[k] if k >= 0 else 0.0) + backward[j, y] - total)
                        dm[:, y] -= p
                        if k >= 0:
                            np.add.at(dw, own[k], -p.sum())
                path, j, y = {e: (s, e, k + 1) for s, e, k in gold}, n, []
                while j > 0:
                    s, _, label = path.get(j, (j - 1, j, 0))
                    y.append((s, j, label))
                    j = s
                by_segment = {(s[0], s[1], s[2]): k for k, s in enumerate(segments)}
                before = 0
                for s, e, label in reversed(y):
                    dm[before, label] += 1
                    if label:
                        np.add.at(dw, own[by_segment[(s, e, label - 1)]], 1)
                    before = label
                dm[before, 0] += 1
                dw -= penalty * w
                w_seen += dw * dw
                m_seen += dm * dm
                w += rate * dw / np.sqrt(w_seen)
                m += rate * dm / np.sqrt(m_seen)
        self.weights = {name: float(w[k]) for name, k in index.items()}
        self.moves = m
        return self


def training_lines(n: int = 240, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Lines with labelled entities in many forms, some next to one another, among words and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "ou", "th", "re", "ion", "é", "sch", "la", "os"]) for _ in range(r.randint(1, 4)))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8)))

    def card(good: bool) -> str:
        while True:
            d = r.choice("3456") + digits(r.choice([15, 15, 15, 15, 17, 18]))
            if luhn(d) == good:
                break
        sep = r.choice(["", "", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone() -> str:
        a, b, c, cc = digits(3), digits(3), digits(4), r.choice(["1", "44", "49", "33", "34"])
        return r.choice([f"+{cc} ({a}) {b}-{c}", f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"({a}) {b}-{c}", f"+{cc}.{a}.{b}.{c}"])

    def email() -> str:
        host = ".".join([name(), *([name()] if r.random() < 0.5 else []), r.choice(["com", "org", "net", "de", "fr"])])
        local = name() + r.choice(["", f".{digits(2)}", f"_{name()}", f".{name()}"])
        if r.random() < 0.25:
            return f"{local} [at] {host.replace('.', ' [dot] ')}" if r.random() < 0.5 else f"{local}(at){host}"
        return f"{local}@{host}"

    octet = lambda: str(r.randint(0, 255))
    good = [email, lambda: ".".join(octet() for _ in range(4)), lambda: card(True), phone]
    bad = [
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: card(False), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"AKIA{name().upper()}{digits(6)}", lambda: digits(r.randint(7, 15)), lambda: f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}",
        lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{octet()}.{octet()}.{octet()}.{octet()}.{octet()}", lambda: f"@{name()}", lambda: f"{digits(4)} {digits(4)} {digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
        lambda: f"pages {digits(3)}-{digits(3)} ({digits(4)})", lambda: f"{digits(22)}", lambda: f"{name()}@{name()}",
    ]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 4)):
            text += r.choice([" ", " ", ", ", ": ", "\n"])
            if r.random() < 0.3:
                text += r.choice(bad)()
            else:
                k = r.randrange(4)
                entity = good[k]()
                spans.append((k, len(text), len(text) + len(entity)))
                text += entity
            if r.random() < 0.55:
                text += r.choice([" ", " ", ". ", ", "]) + word()
        out.append((text + r.choice(["", ".", " " + word()]), spans))
    return out


_fitted: list[SegmentModel] = []


def trained_model() -> SegmentModel:
    """The model fitted on the generated lines; fitted once a process."""
    if not _fitted:
        _fitted.append(SegmentModel().fit(training_lines()))
    return _fitted[0]


def all_spans(text: str, model: SegmentModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in the order of kinds, then starts."""
    base = base_spans(text)
    added = [s for a, b in zones(text) for s in model.decode(text, a, b)]
    by_start = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in by_start], [0, *itertools.accumulate((b for _, b in by_start), max)]
    new = [s for s in added if reach[bisect.bisect_left(starts, s[2])] <= s[1]]  # none that begins before its end goes beyond its start
    return base, sorted(base + new)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(documents: DataFrame, model: SegmentModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCHEMA for every document; the n_ columns count base spans."""
    model = model or trained_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(KINDS)), dtype=np.int64)
            hashes, spans = [], []
            for k, text in enumerate(batch.column(1)):
                base, found = all_spans(text.as_py() or "", model)
                for kind, _, _ in base:
                    counts[k, kind] += 1
                hashes.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask_personal_data(documents: DataFrame, model: SegmentModel | None = None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all spans of the text masked."""
    model = model or trained_model()
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, all_spans(t, model)[1]) for x in batch.column(place)]
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
