import random
import zlib

import pytest

from paperloom.plans.query_documents import PDF_KINDS, _pdf
from paperloom.sources import pdf


@pytest.mark.parametrize("kind", PDF_KINDS[:5])
def test_counts_of_generated_files(kind):
    for n in (0, 1, 2, 9, 10, 11, 57, 300):
        assert pdf.page_count(_pdf(n, kind)) == n + (kind == "changed")


@pytest.mark.parametrize("kind", PDF_KINDS[:5])
def test_walk_over_the_leaves_agrees(kind):
    found = pdf.Pdf(_pdf(23, kind))
    assert found._leaves(found.get(found.trailer[b"Root"])[b"Pages"]) == 23 + (kind == "changed")


def test_objects():
    value, end = pdf.parse(b"<< /A [1 -2 3.5 (x\\)(y)) <0aF> /N#41me true null] % c\n /B 12 0 R /C << /D [ [ ] ] >> >> rest", 0)
    assert value == {b"A": [1, -2, 0.0, None, None, b"NAme", True, None], b"B": pdf.Ref(12), b"C": {b"D": [[]]}} and end < 100
    deep, _ = pdf.parse(b"[" * 50_000 + b"]" * 50_000, 0)
    assert isinstance(deep, list)
    for bad in (b"<< /A", b"]", b"[1", b"(open", b"<< ]", b"word"):
        with pytest.raises(pdf.NotReadable):
            pdf.parse(bad, 0)


def test_broken_files_are_errors_or_counts_and_end():
    """Bytes changed or cut anywhere: a count, or an error, in good time."""
    r = random.Random(3)
    for kind in PDF_KINDS[:5]:
        whole = _pdf(12, kind)
        for _ in range(150):
            data = bytearray(whole[: r.randint(0, len(whole))]) if r.random() < 0.3 else bytearray(whole)
            for _ in range(r.randint(0, 6)):
                if data:
                    data[r.randrange(len(data))] = r.choice([0, 32, 48, 57, 60, 62, 91, 255])
            try:
                assert pdf.page_count(bytes(data)) >= 0
            except ValueError:
                pass


def test_loops_end():
    loop = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [2 0 R 3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page >>\nendobj\n4 0 obj\n4 0 R\nendobj\n"
    assert pdf.page_count(loop) == 1
    with pytest.raises(ValueError):
        pdf.page_count(loop.replace(b"/Pages 2 0 R", b"/Pages 4 0 R"))
    table = _pdf(3, "table")
    at = table.rindex(b"xref\n0 1")
    assert pdf.page_count(table.replace(b"/Root 1 0 R", b"/Root 1 0 R /Prev %d" % at)) == 3
    bomb = zlib.compress(bytes(10_000_000))
    data = b"%PDF-1.5\n7 0 obj\n<< /Type /XRef /W [1 2 1] /Size 5 /Filter /FlateDecode /Length " + str(len(bomb)).encode() + b" >>\nstream\n" + bomb + b"\nendstream\nendobj\nstartxref\n9\n%%EOF"
    with pytest.raises(ValueError):
        pdf.Pdf(data, max_stream_bytes=1000)


def test_table(spark):
    rows = [("a", _pdf(4)), ("b", b"?"), ("c", None), ("d", b"%PDF-1.7")]
    got = {r.key: (r.n_pages, r.error) for r in pdf.page_counts(spark.createDataFrame(rows, "key string, content binary"), "key").collect()}
    assert got == {"a": (4, None), "b": (None, "not a PDF"), "c": (None, "not a PDF"), "d": (None, "no catalog")}
