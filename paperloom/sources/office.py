"""Text of office documents: the paragraphs of DOCX, the shapes of PPTX slides."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.functions import mime as mimes

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _clean(parts: list[str]) -> str:
    return "\n\n".join(parts).replace("\r\n", "\n").strip()


def docx_text(content: bytes) -> str:
    """Paragraphs of the body (not of tables or headers) that are not empty, a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    texts = ["".join(t.text or "" if t.tag == f"{_W}t" else marks.get(t.tag, "") for r in p.iter(f"{_W}r") for t in r) for p in (body if body is not None else ()) if p.tag == f"{_W}p"]
    return _clean([t for t in texts if t])


def pptx_text(content: bytes) -> str:
    """Shapes with text, slide after slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for _, name in slides:
            for shape in ElementTree.fromstring(z.read(name)).iter(f"{_P}sp"):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p"))
                if text.strip():
                    out.append(text)
    return _clean(out)


def office_text(files: DataFrame, content: str = "content", mime: str = "mime", batch_bytes: int = 1 << 22) -> DataFrame:
    """Files with `text` and `error`: the document's text, empty for other types. Rows leave the task every `batch_bytes` of files and text, as texts may be far larger than files."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, size, low = [], [], 0, 0
            for k in range(batch.num_rows):
                data, kind = batch.column(names.index(content))[k].as_py(), batch.column(names.index(mime))[k].as_py()
                reader = {mimes.DOCX: docx_text, mimes.PPTX: pptx_text}.get(kind)
                try:
                    texts.append(reader(data) if reader else "")
                    errors.append(None)
                except Exception as e:  # an unreadable file is a result
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                size += len(data or b"") + len(texts[-1] or "")
                if size >= batch_bytes or k + 1 == batch.num_rows:
                    kept = [c.slice(low, len(texts)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*names, "text", "error"])
                    texts, errors, size, low = [], [], 0, k + 1

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "text string", "error string"])
    return files.mapInArrow(run, schema)
