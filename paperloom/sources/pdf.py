"""Page counts of PDF files from their structure: cross-reference tables and streams, object streams, the page tree.

The file's end names its cross-reference section; sections chain backwards to older ones, whose entries
count where newer ones have none. The trailer names the catalog, the catalog the page tree, and the
tree's root its number of pages. A count that is missing or not a number is replaced by a walk over the tree's leaves. Files
whose cross-references are broken are read by looking for `n g obj` marks, as other readers do.

Cases: bytes that are no PDF, object streams that are encrypted, and files without a page tree are errors, as
rows. Loops in chains and trees end. Objects may nest as deep as memory allows: the reader keeps a stack.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_SPACE = b"\0\t\n\x0c\r "
_TOKEN = re.compile(rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*[\0\t\n\x0c\r ]*)*(<<|>>|\[|\]|/[^\0\t\n\x0c\r ()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|\(|<[0-9A-Fa-f\0\t\n\x0c\r ]*>|[A-Za-z'\"*]+|[{}])")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![A-Za-z])")
_STREAM = re.compile(rb"[\0\t\n\x0c\r ]*stream(\r\n|\n|\r)")
_ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])")


class NotReadable(ValueError):
    pass


class Ref(NamedTuple):
    number: int


class Name(bytes):
    pass


def _string_end(data: bytes, at: int) -> int:
    """Past the parenthesis that closes a string whose first one is before `at`."""
    depth = 1
    while depth:
        m = re.compile(rb"[()\\]").search(data, at)
        if m is None:
            raise NotReadable("a string without an end")
        at = m.end() + (m[0] == b"\\")
        depth += (m[0] == b"(") - (m[0] == b")")
    return at


def parse(data: bytes, at: int) -> tuple[object, int]:
    """The object at a place, and the place behind it. Strings are None, names Name, references Ref."""
    stack: list[tuple[str, list]] = []
    while True:
        m = _TOKEN.match(data, at)
        if m is None:
            raise NotReadable("no object where one is expected")
        token, at = m[1], m.end()
        if token in (b"<<", b"["):
            stack.append(("<<" if token == b"<<" else "[", []))
            continue
        if token in (b">>", b"]"):
            if not stack or (stack[-1][0] == "<<") != (token == b">>"):
                raise NotReadable("an end without a beginning")
            kind, items = stack.pop()
            value: object = {items[k]: items[k + 1] for k in range(0, len(items) - 1, 2) if isinstance(items[k], Name)} if kind == "<<" else items
        elif token == b"(":
            value, at = None, _string_end(data, at)
        elif token[:1] == b"<":
            value = None
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]))
        elif token == b"R" and stack and len(stack[-1][1]) >= 2:
            _, number = stack[-1][1].pop(), stack[-1][1].pop()
            if not isinstance(number, int):
                raise NotReadable("a reference to nothing")
            value = Ref(number)
        elif token[:1] in b"+-.0123456789":
            value = int(token) if re.fullmatch(rb"[+-]?\d{1,18}", token) else 0.0
        elif token in (b"true", b"false", b"null"):
            value = {b"true": True, b"false": False, b"null": None}[token]
        elif token in (b"R", b"endobj"):
            value = None
        else:
            raise NotReadable("an unknown word")
        if not stack:
            return value, at
        stack[-1][1].append(value)


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows whose first byte names a PNG filter; xref streams use none, the byte before, or the row above."""
    out, above = bytearray(), bytearray(columns)
    for low in range(0, len(data) - columns, columns + 1):
        kind, row = data[low], bytearray(data[low + 1 : low + 1 + columns])
        if kind == 1:
            for k in range(1, columns):
                row[k] = (row[k] + row[k - 1]) & 255
        elif kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, above))
        elif kind:
            raise NotReadable("an unknown predictor")
        out += row
        above = row
    return bytes(out)


class Pdf:
    def __init__(self, data: bytes, max_stream_bytes: int = 1 << 28) -> None:
        if b"%PDF-" not in data[:1024]:
            raise NotReadable("not a PDF")
        self.data, self.limit = data, max_stream_bytes
        self.places: dict[int, int | tuple[int, int]] = {}  # in the file, or (object stream, index)
        self.trailer: dict[bytes, object] = {}
        self.packed: dict[int, dict[int, object]] = {}
        try:
            self._sections()
            if not isinstance(self.get(self.trailer.get(b"Root")), dict):
                raise NotReadable("no catalog")
        except (ValueError, TypeError, IndexError, zlib.error):
            self._look_for_objects()

    def get(self, value: object) -> object:
        """What a reference stands for."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self._object(value.number)
        raise NotReadable("references in a circle")

    def _object(self, number: int) -> object:
        place = self.places.get(number)
        if place is None:
            return None
        if isinstance(place, tuple):
            if place[0] not in self.packed:
                self.packed[place[0]] = self._unpack(place[0])
            return self.packed[place[0]].get(number)
        m = _OBJECT.match(self.data, place)
        if m is None or int(m[1]) != number:
            raise NotReadable("no object at its place")
        return parse(self.data, m.end())[0]

    def _stream(self, place: int) -> tuple[dict, bytes]:
        m = _OBJECT.match(self.data, place)
        if m is None:
            raise NotReadable("no stream at its place")
        head, at = parse(self.data, m.end())
        begin = _STREAM.match(self.data, at)
        if not isinstance(head, dict) or begin is None:
            raise NotReadable("no stream at its place")
        length = self.get(head.get(b"Length")) if not isinstance(head.get(b"Length"), Ref) or self.places else None
        end = begin.end() + length if isinstance(length, int) and length >= 0 else -1
        if end < 0 or not self.data[end : end + 20].lstrip(_SPACE).startswith(b"endstream"):
            end = self.data.find(b"endstream", begin.end())
            if end < 0:
                raise NotReadable("a stream without an end")
        body = self.data[begin.end() : end]
        filters = head.get(b"Filter")
        filters = filters if isinstance(filters, list) else [filters] if filters is not None else []
        if any(f != b"FlateDecode" for f in filters):
            raise NotReadable("an unknown filter")
        if filters:
            body = zlib.decompressobj().decompress(body, self.limit + 1)
            if len(body) > self.limit:
                raise NotReadable("a stream too large")
        options = head.get(b"DecodeParms")
        options = options[0] if isinstance(options, list) and options else options
        if isinstance(options, dict) and isinstance(options.get(b"Predictor"), int) and options[b"Predictor"] >= 10:
            body = _unpredicted(body, options.get(b"Columns", 1))
        return head, body

    def _unpack(self, number: int) -> dict[int, object]:
        place = self.places.get(number)
        if not isinstance(place, int):
            raise NotReadable("an object stream without a place")
        head, body = self._stream(place)
        n, first = self.get(head.get(b"N")), self.get(head.get(b"First"))
        if not isinstance(n, int) or not isinstance(first, int):
            raise NotReadable("an object stream without numbers")
        pairs = body[:first].split()
        out = {}
        for k in range(min(n, len(pairs) // 2)):
            if int(pairs[2 * k]) in self.places:
                out[int(pairs[2 * k])] = parse(body, first + int(pairs[2 * k + 1]))[0]
        return out

    def _sections(self) -> None:
        at = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref[\0\t\n\x0c\r ]*(\d{1,18})").match(self.data, at) if at >= 0 else None
        if m is None:
            raise NotReadable("no startxref")
        waiting, seen = [int(m[1])], set()
        while waiting:
            at = waiting.pop(0)
            if at in seen or at >= len(self.data):
                if at in seen:
                    continue
                raise NotReadable("a section beyond the end")
            seen.add(at)
            start = re.compile(rb"[\0\t\n\x0c\r ]*xref").match(self.data, at)
            trailer = self._table(start.end()) if start else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            for name in (b"XRefStm", b"Prev"):
                if isinstance(trailer.get(name), int) and trailer[name] >= 0:
                    waiting.append(trailer[name])

    def _table(self, at: int) -> dict:
        head = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,10})[ ]+(\d{1,10})[\0\t\n\x0c\r ]")
        while m := head.match(self.data, at):
            number, at = int(m[1]), m.end()
            for k in range(int(m[2])):
                e = _ENTRY.match(self.data, at)
                if e is None:
                    raise NotReadable("a broken cross-reference table")
                if e[3] == b"n":
                    self.places.setdefault(number + k, int(e[1]))
                at = e.end()
        m = re.compile(rb"[\0\t\n\x0c\r ]*trailer").match(self.data, at)
        trailer = parse(self.data, m.end())[0] if m else None
        if not isinstance(trailer, dict):
            raise NotReadable("no trailer")
        return trailer

    def _xref_stream(self, at: int) -> dict:
        m = re.compile(rb"[\0\t\n\x0c\r ]*").match(self.data, at)
        head, body = self._stream(m.end())
        widths = head.get(b"W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
            raise NotReadable("a broken cross-reference stream")
        index = head.get(b"Index") or [0, head.get(b"Size", 0)]
        size, low = sum(widths), 0
        if not size:
            raise NotReadable("a broken cross-reference stream")
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                row = body[low : low + size]
                if len(row) < size:
                    return head
                low += size
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                if kind == 1:
                    self.places.setdefault(number, int.from_bytes(row[a:b], "big"))
                elif kind == 2:
                    self.places.setdefault(number, (int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:size], "big")))
        return head

    def _look_for_objects(self) -> None:
        """Every `n g obj` in the file, the last of a number; objects in streams as well; a trailer or the catalog itself."""
        self.places, self.packed, self.trailer = {}, {}, {}
        for m in _OBJECT.finditer(self.data):
            self.places[int(m[1])] = m.start()
        catalog = None
        for number, place in list(self.places.items()):
            try:
                value = parse(self.data, _OBJECT.match(self.data, place).end())[0]
                if not isinstance(value, dict):
                    continue
                if value.get(b"Type") == b"ObjStm":
                    _, body = self._stream(place)
                    first = self.get(value.get(b"First"))
                    for k, n in enumerate(body[:first].split()[::2]):
                        self.places.setdefault(int(n), (number, k))
                elif value.get(b"Type") == b"Catalog":
                    catalog = Ref(number)
            except (NotReadable, zlib.error, ValueError, TypeError):
                continue
        if catalog is None:
            catalog = next((Ref(n) for n, p in self.places.items() if isinstance(p, tuple) and isinstance(v := self._quiet(n), dict) and v.get(b"Type") == b"Catalog"), None)
        if catalog is None:
            raise NotReadable("no catalog")
        self.trailer = {b"Root": catalog}

    def _quiet(self, number: int) -> object:
        try:
            return self._object(number)
        except (NotReadable, zlib.error, ValueError, TypeError):
            return None

    def pages(self) -> int:
        catalog = self.get(self.trailer.get(b"Root"))
        root = self.get(catalog.get(b"Pages")) if isinstance(catalog, dict) else None
        if not isinstance(root, dict):
            raise NotReadable("no page tree")
        count = self.get(root.get(b"Count"))
        return count if isinstance(count, int) and not isinstance(count, bool) and count >= 0 else self._leaves(catalog[b"Pages"])

    def _leaves(self, root: object) -> int:
        n, waiting, seen = 0, [root], set()
        while waiting:
            ref = waiting.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get(b"Kids"))
                if isinstance(kids, list):
                    waiting += kids
                else:
                    n += 1
        return n


def page_count(data: bytes) -> int:
    try:
        return Pdf(data).pages()
    except (zlib.error, TypeError, IndexError, OverflowError) as e:
        raise NotReadable(f"broken: {e}") from e


def page_counts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, n_pages, error of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, errors = [], []
            for value in batch.column(1):
                try:
                    counts.append(page_count(value.as_py() or b""))
                    errors.append(None)
                except ValueError as e:
                    counts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(errors, pa.string())], names=[key, "n_pages", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, n_pages bigint, error string")
