"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: text between block-level tags, with inline tags removed,
character references decoded and white space made one space. Each block is described by its
ancestors' tags and the words of their class, id and role attributes, its own tag, and its text
(length, share of links, punctuation, digits, capitals, place). The chain labels blocks as main
text or not; Viterbi finds the best labelling; main blocks are joined by one space.

The model is trained on labelled pages that `training_pages` generates in many layouts: menus,
headers, notices, adverts, sidebars, forms, comments and footers around and inside articles.

Scale: one narrow pass; the model is some hundred numbers in the closure. Work is linear in the
page, whatever it holds: tags are read by a scanner that never reads a stretch twice, open elements
are counted by name, and an element keeps its parent and just the features that its ancestors lack,
so depth costs nothing.

Cases: null, empty and unparsable pages give an empty text. Pages are whole; unclosed elements end
with the page, and a tag that the page's end cuts is markup. A quote that never closes is a plain
character. Repeated rows and null ids give repeated results. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARKUP = re.compile(r"[>\"']")
_NOT_LETTER = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d")
#: A reference to a number far beyond the last code point; converting thousands of digits would fail.
_LONG_REFERENCE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,});?")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
#: Elements without an end tag; elements whose content is not text; elements that stay inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style template noscript iframe svg math object select textarea".split())
#: Of these, the first end at their end tag alone; in the others a block's tag ends what has no end tag, and always in a drawing or a formula.
RAW, DRAWN = frozenset("script style".split()), frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_TAG = re.compile(r"<(?:/?(?:p|div|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|section|article|main|header|footer|nav|aside|blockquote|pre|form|figure)|/(?:body|html))(?=[\s/>])", re.I)
_LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_LIMIT = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote".split())
MARK = "\ue000"  # stands in training pages where main text begins a block


class Element:
    """An open element: its tag, its parent, and those of its features that no ancestor has."""

    __slots__ = ("tag", "parent", "features", "score")

    def __init__(self, tag: str, parent: Element | None, features: list[str]) -> None:
        self.tag, self.parent, self.features = tag, parent, features
        self.score: float | None = None


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def _element_features(tag: str, attributes: str) -> list[str]:
    words = " ".join(x for m in _ATTRIBUTE.finditer(attributes) for x in m.groups() if x).lower() if "=" in attributes else ""
    out = [f"in={_NOT_LETTER.split(tag)[0]}", *(f"word={w}" for w in _NOT_LETTER.split(words) if w)]
    if _HIDDEN.search(attributes):
        out.append("word=hidden")
    return out


class _OpenElements:
    """The stack of open elements, with where each tag and feature stands in it."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.limits: list[int] = []
        self.counts: dict[str, int] = {}

    def push(self, tag: str, attributes: str) -> None:
        fresh = []
        for f in dict.fromkeys(_element_features(tag, attributes)):
            if not self.counts.get(f):
                fresh.append(f)
                self.counts[f] = 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _LIMIT:
            self.limits.append(len(self.stack))
        self.stack.append(Element(tag, self.stack[-1] if self.stack else None, fresh))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            if gone.tag in _LIMIT:
                self.limits.pop()
            for f in gone.features:
                self.counts[f] = 0

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.pop_to(self.places[tag][-1])

    def close(self, tags: set[str]) -> None:
        """The innermost of these elements ends, unless a limiting element stands inside it."""
        place = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if place >= 0 and place >= (self.limits[-1] if self.limits else -1):
            self.pop_to(place)


class _Scanner:
    """Tags of a page, from left to right."""

    def __init__(self, page: str) -> None:
        self.page, self.at, self.quotes = page, 0, True
        self.last_quote = {'"': page.rfind('"'), "'": page.rfind("'")}
        self.last_end = page.rfind(">")
        self.ahead: dict[object, re.Match[str] | None] = {}

    def following(self, key: object, pattern: str | re.Pattern[str]) -> re.Match[str] | None:
        """The next match from here on; each is searched for once, so that all calls together read the page once a pattern."""
        if key not in self.ahead or (self.ahead[key] and self.ahead[key].start() < self.at):
            self.ahead[key] = re.compile(pattern, re.I).search(self.page, self.at) if isinstance(pattern, str) else pattern.search(self.page, self.at)
        return self.ahead[key]

    def tag_end(self, at: int) -> int:
        """The place of the sign that ends a tag; a sign within quotes that close does not. -1 if the page ends before."""
        if at > self.last_end:
            return -1
        if self.quotes:
            here = at
            while m := _MARKUP.search(self.page, here):
                if m[0] == ">":
                    return m.start()
                here = m.end()
                if here <= self.last_quote[m[0]]:
                    here = self.page.index(m[0], here) + 1
            self.quotes = False  # some quote of this tag takes the page's rest with it: from here on none counts
        return self.page.find(">", at)

    def next(self) -> tuple[str, str, bool, str] | None:
        """The text before the next tag, its name (empty for comments and the like), whether it ends an element, its attributes."""
        page, low = self.page, self.at
        if low >= len(page):
            return None
        start = page.find("<", low)
        while start >= 0:
            following = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else len(page)
                return page[low:start], "", False, ""
            if m := _NAME.match(page, start + 1):
                end = self.tag_end(m.end())
                self.at = end + 1 if end >= 0 else len(page)
                return page[low:start], m[1].lower(), following == "/", page[m.end() : end] if end >= 0 else ""
            if following and following in "!?/" and start < self.last_end:
                self.at = page.index(">", start) + 1
                return page[low:start], "", False, ""
            start = page.find("<", start + 1)
        self.at = len(page)
        return page[low:], "", False, ""

    def skip(self, name: str) -> None:
        """On past the end tag of an element whose content is no text, or to the block's tag that ends it."""
        close = self.following(f"/{name}", rf"</{name}(?=[\s/>])")
        if name not in RAW and (close is None or name in DRAWN):
            block = self.following("block", _BLOCK_TAG)
            foreign = close is not None and (f := self.following("foreign", r"<foreignobject")) is not None and f.start() < close.start()
            if block is not None and not foreign and (close is None or block.start() < close.start()):
                self.at = block.start()
                return
        end = self.page.find(">", close.end()) if close else -1
        self.at = end + 1 if end >= 0 else len(self.page)

    def link_closes(self) -> bool:
        """Whether a link that opens here has an end tag of its own."""
        found = self.following("link", _LINK_TAG)
        return found is not None and found[1] == "/"


def leaf_blocks(page: str) -> list[Block]:
    """The blocks in page order, each with the innermost element that is open."""
    out: list[Block] = []
    pieces: list[str] = []
    opened, scanner = _OpenElements(), _Scanner(page)
    linked = links = 0  # a link is 2 up to its end tag, 1 up to its block's end where it has none

    def flush() -> None:
        nonlocal linked, links
        links = 0 if links == 1 else links
        if pieces:
            text = " ".join(html.unescape(_LONG_REFERENCE.sub("\ufffd", "".join(pieces))).split())
            pieces.clear()
            if text:
                out.append(Block(opened.stack[-1] if opened.stack else None, text, linked))
        linked = 0

    while found := scanner.next():
        chunk, name, ending, attributes = found
        if chunk:
            pieces.append(chunk)
            if links:
                linked += len(chunk)
        if not name:
            continue
        if name in OPAQUE:
            if not ending and not attributes.endswith("/"):
                scanner.skip(name)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if ending else 2 if scanner.link_closes() else 1
            continue
        flush()
        if name in VOID:
            continue
        if ending:
            opened.end(name)
            continue
        closes = _CLOSES.get(name, {"p"} if opened.places.get("p") else None)  # a block ends an open paragraph
        if closes:
            opened.close(closes)
        if not attributes.endswith("/"):
            opened.push(name, attributes)
    flush()
    return out


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a training page, and 1 for those that begin with MARK."""
    found = leaf_blocks(page)
    labels = [int(b.text.startswith(MARK)) for b in found]
    for b in found:
        b.text = b.text.replace(MARK, "")
    return found, labels


def path_features(element: Element | None) -> list[str]:
    """All features of an element and its ancestors; only for training pages, which are shallow."""
    out = [f"own={_NOT_LETTER.split(element.tag)[0]}" if element else "own=none"]
    while element:
        out += element.features
        element = element.parent
    return sorted(out)


def text_features(block: Block, place: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    out = [f"words={min(words.bit_length(), 7)}", f"place={min(4 * place // n, 3)}", f"links={min(int(4 * block.linked / max(len(text), 1)), 4)}"]
    if text[-1] in ".!?…:\"'”»":
        out.append("sentence end")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("separators")
    if len(_DIGITS.findall(text)) > 0.2 * len(text):
        out.append("digits")
    if text.isupper():
        out.append("capitals")
    return out


class BlockModel:
    """Two labels, 0 other and 1 main. Feature weights speak for main; moves and ends are per label."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.start = np.zeros(2)

    def path_score(self, element: Element | None) -> float:
        """The sum of weights along the ancestors, kept at each element."""
        get, waiting = self.weights.get, []
        while element is not None and element.score is None:
            waiting.append(element)
            element = element.parent
        score = element.score if element is not None else 0.0
        for e in reversed(waiting):
            score = e.score = score + sum(get(f, 0.0) for f in e.features)
        return score

    def scores(self, found: list[Block]) -> np.ndarray:
        get = self.weights.get
        out = np.empty(len(found))
        for k, block in enumerate(found):
            own = f"own={_NOT_LETTER.split(block.element.tag)[0]}" if block.element else "own=none"
            out[k] = get("bias", 0.0) + get(own, 0.0) + self.path_score(block.element) + sum(get(f, 0.0) for f in text_features(block, k, len(found)))
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        """The best labelling, by Viterbi."""
        if not found:
            return []
        moves, back = self.moves.tolist(), []
        main = self.scores(found).tolist()
        a, b = float(self.start[0]), float(self.start[1]) + main[0]
        for s in main[1:]:
            from_a, from_b = (a + moves[0][0], b + moves[1][0]), (a + moves[0][1], b + moves[1][1])
            back.append((from_a[1] > from_a[0], from_b[1] > from_b[0]))
            a, b = max(from_a), max(from_b) + s
        label, out = b > a, []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return [*out, label][::-1]

    def fit(self, pages: list[str], rounds: int = 10, rate: float = 0.5, penalty: float = 1e-3) -> BlockModel:
        """Maximum likelihood of the labelled pages by adaptive gradient steps, with forward and backward sums."""
        data, index = [], {}
        for page in pages:
            found, labels = labelled_blocks(page)
            rows = [np.array([index.setdefault(f, len(index)) for f in ("bias", *path_features(b.element), *text_features(b, k, len(found)))]) for k, b in enumerate(found)]
            data.append((rows, np.array(labels)))
        w, moves, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
        seen, moves_seen, start_seen = np.full(len(index), 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
        for _ in range(rounds):
            for rows, labels in data:
                n = len(rows)
                if not n:
                    continue
                score = np.zeros((n, 2))
                score[:, 1] = [w[r].sum() for r in rows]
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = start + score[0]
                for k in range(1, n):
                    forward[k] = score[k] + np.logaddexp(forward[k - 1, 0] + moves[0], forward[k - 1, 1] + moves[1])
                for k in range(n - 2, -1, -1):
                    ahead = moves + (score[k + 1] + backward[k + 1])[None, :]
                    backward[k] = np.logaddexp(ahead[:, 0], ahead[:, 1])
                total = np.logaddexp(*forward[-1])
                p = np.exp(forward + backward - total)
                dw = np.zeros(len(index))
                for k, r in enumerate(rows):
                    dw[r] += labels[k] - p[k, 1]
                dmoves = np.zeros((2, 2))
                for k in range(1, n):
                    dmoves[labels[k - 1], labels[k]] += 1
                    dmoves -= np.exp(forward[k - 1][:, None] + moves + (score[k] + backward[k])[None, :] - total)
                dstart = -p[0]
                dstart[labels[0]] += 1
                dw -= penalty * w
                seen += dw * dw
                moves_seen += dmoves * dmoves
                start_seen += dstart * dstart
                w += rate * dw / np.sqrt(seen)
                moves += rate * dmoves / np.sqrt(moves_seen)
                start += rate * dstart / np.sqrt(start_seen)
        self.weights = {f: float(w[k]) for f, k in index.items()}
        self.moves, self.start = moves, start
        return self


def main_text(page: str, model: BlockModel) -> str:
    found = leaf_blocks(page)
    return " ".join(b.text for b, main in zip(found, model.decode(found)) if main)


#: Attribute words of the generated layouts, by part; the model knows ancestors by these words and by tags.
PART_WORDS = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "toc", "skip", "links", "tags"],
    "header": ["header", "masthead", "branding", "topbar", "tagline", "logo", "hero banner"],
    "notice": ["cookie", "cookies", "consent", "notice", "banner", "alert", "gdpr", "paywall", "popup", "modal", "disclaimer", "message"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense", "sponsor", "promotion", "adbox", "banner ad"],
    "sidebar": ["sidebar", "side", "rail", "widget", "related", "trending", "popular", "aside", "recommended", "more", "teaser", "author bio"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact", "survey"],
    "share": ["share", "social", "sharing", "follow", "toolbar", "buttons"],
    "comments": ["comments", "comment", "discussion", "replies", "respond", "reply", "disqus", "comment list", "reader comments", "feedback", "thread"],
    "footer": ["footer", "copyright", "bottom", "legal", "colophon", "imprint", "credits"],
    "main": ["content", "article", "post", "entry", "story", "main", "body", "article body", "post content", "entry content", "text", "page content"],
}


def training_pages(n: int = 300, seed: int = 11) -> list[str]:
    """Pages whose main blocks begin with MARK."""
    r = random.Random(seed)
    syllables = ["an", "er", "ou", "th", "re", "ion", "é", "sch", "la", "os", "ing", "and", "ent"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentence(low: int = 3, high: int = 18) -> str:
        out = words(low, high).capitalize()
        if r.random() < 0.1:
            out = " ".join(w + r.choice(["###", "$$$", "%%%", "&amp;&amp;&amp;", "***"]) for w in out.split())
        elif r.random() < 0.05:
            out = "!! ".join(out.upper().split())
        elif r.random() < 0.05:
            out = " | ".join(out.split())
        if r.random() < 0.06:
            out += r.choice([" +1 (212) 555-0100", " a.b@c.example", " &copy; 2020", " 4.0", ' token = "9f9f"'])
        return out + r.choice([".", ".", ".", "", "!", "?"])

    def prose(mark: str) -> str:
        text = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
        if r.random() < 0.25:
            text = f"<b>{text}</b>" if r.random() < 0.5 else text.replace(" ", f' <a href="/x">{word()}</a> ', 1)
        return mark + text

    def attributes(part: str) -> str:
        value = r.choice(PART_WORDS[part])
        if r.random() < 0.3:
            value += " " + r.choice(["box", "wrap", "container", "top", "inner", "clearfix"])
        return f' {r.choice(["class", "class", "id"])}="{value.replace(" ", r.choice(["-", " ", "_"]))}"'

    def box(tags: list[str], part: str, inner: str, plain: bool = True) -> str:
        tag = r.choice(tags)
        bare = plain and tag not in ("div", "section", "p", "span")
        return f"<{tag}{'' if bare and r.random() < 0.6 else attributes(part)}>{inner}</{tag}>"

    def link_list() -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(r.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice([" ", " | "]).join(items)

    def other_prose(count: int = 2) -> str:
        return "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<li>{}</li>", "{}"]).format(prose("")) for _ in range(r.randint(1, count)))

    def extra() -> str:
        return r.choice(
            [
                lambda: box(["div", "aside", "section"], "advert", other_prose(1), False), lambda: box(["div", "p"], "advert", prose(""), False), lambda: box(["div"], "share", link_list()),
                lambda: f"<{(t := r.choice(['p', 'div']))} {r.choice(['hidden', 'style=\"display:none\"'])}>{prose('')}</{t}>", lambda: box(["aside", "div", "section"], "sidebar", f"<h3>{words(1, 3)}</h3>" + (link_list() if r.random() < 0.6 else other_prose(3))),
                lambda: box(["form", "div"], "form", f"<form><p>{sentence()}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>"), lambda: box(["div", "section"], "notice", other_prose(2)),
            ]
        )()

    def article(bare: bool = False) -> str:
        parts = [f"<h1>{MARK}{words(3, 10)}</h1>"] if r.random() < (0.3 if bare else 0.85) else []
        for _ in range(r.choice([1, 1, 2, 3, 5]) if bare else r.randint(1, 10)):
            kind = r.random()
            if kind < 0.68:
                parts.append(f"<p>{prose(MARK)}</p>")
            elif kind < 0.76:
                parts.append(f"<p><b>{prose(MARK)}<br>")
            elif kind < 0.82:
                parts.append(f"<h2>{MARK}{words(1, 7)}</h2><p>{prose(MARK)}</p>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{prose(MARK)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{prose(MARK)}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 4)}</td></tr></table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{prose(MARK)}</figcaption></figure>")
            else:
                parts.append(f"<div>{prose(MARK)}</div>")
            if r.random() < (0.05 if bare else 0.2):
                parts.append(extra())
        return "".join(parts)

    def bare_page() -> str:
        """An article and hardly anything else."""
        body = article(True)
        body = r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}", "{}"]).format(body)
        head = r.choice(["", "<head></head>", f"<head><title>{words(2, 6)}</title></head>"])
        out = box(["nav", "header"], "menu", link_list()) if r.random() < 0.15 else ""
        foot = box(["footer", "div"], "footer", f"&copy; {word()}") if r.random() < 0.2 else ""
        return f"<html>{head}<body>{out}{body}{foot}</body></html>"

    def page() -> str:
        title = words(3, 8)
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        out = []
        if r.random() < 0.5:
            out.append(box(["header", "header", "div"], "header", r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{sentence()}</p>", f"<div>{words(1, 3)}</div>"]) + (box(["nav"], "menu", link_list()) if r.random() < 0.4 else "")))
        if r.random() < 0.8:
            out.append(box(["nav", "nav", "div", "ul"], "menu", link_list()))
        for chance, make in ((0.4, lambda: box(["div", "section"], "notice", other_prose(2))), (0.5, lambda: box(["div", "aside"], "advert", other_prose(1), False)), (0.25, extra)):
            if r.random() < chance:
                out.append(make())
        body = article()
        layout = r.random()
        body = f"<article>{body}</article>" if layout < 0.5 else f"<main>{body}</main>" if layout < 0.6 else box(["div", "section"], "main", body) if layout < 0.9 else f"<div>{body}</div>" if layout < 0.97 else body
        if r.random() < 0.2:
            body = f"<main>{body}</main>" if "<main" not in body else f"<div>{body}</div>"
        after = []
        if r.random() < 0.4:
            replies = "".join(box(["div", "li", "article"], "comments", f"<b>{words(1, 2)}</b><p>{prose('')}</p>", False) for _ in range(r.randint(1, 4)))
            after.append(box(["section", "div", "ol"], "comments", f"<h2>{words(1, 3)}</h2>{replies}", False))
        if r.random() < 0.35:
            after.append(box(["aside", "div"], "sidebar", f"<h3>{words(1, 3)}</h3>" + other_prose(3)))
        if r.random() < 0.3:
            after.append(extra())
        foot = box(["footer", "footer", "div"], "footer", r.choice(["&copy; ", "", "&copy; 2021 "]) + f"{word()}.example.com &middot; {sentence()}" + (link_list() if r.random() < 0.3 else "")) if r.random() < 0.85 else ""
        if r.random() < 0.25 and after:
            out, after = out + after, []
        whole = head + "".join(out) + body + "".join(after) + foot
        return whole if r.random() < 0.1 else whole + "</body></html>"

    return [bare_page() if k % 6 == 5 else page() for k in range(n)]


_fitted: list[BlockModel] = []


def trained_model() -> BlockModel:
    """The model fitted on the generated pages; fitted once a process."""
    if not _fitted:
        _fitted.append(BlockModel().fit(training_pages()))
    return _fitted[0]


def extract_main_text(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """page_id, url, and the main text of every page with its length in code points."""
    model = model or trained_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(x.as_py() or "", model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)
