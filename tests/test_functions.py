import base64
import binascii
import datetime
import pathlib
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import mime, text

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, f, kind="string"):
    """f over a column of values, in their order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


@FEW
@given(st.lists(st.text(), min_size=1, max_size=40))
def test_normalize_is_pythons_strip(spark, values):
    values = [v.replace("\x00", " ") for v in values if all(not 0xD800 <= ord(c) < 0xE000 for c in v)] or [""]
    assert column(spark, values, text.normalize_text) == [v.replace("\r\n", "\n").strip() for v in values]


def test_normalize_literals(spark):
    values = [" \t a \r\n", "a\rb", "\x0b\x1c\x85\xa0 x  　", None, "", "a\r\n\r\nb"]
    assert column(spark, values, text.normalize_text) == ["a", "a\rb", "x", None, "", "a\n\nb"]


def lenient(body):
    try:
        return base64.b64decode(body)
    except binascii.Error:
        return b""


@FEW
@given(st.lists(st.text(alphabet="aGk=@ +/Z9-", max_size=14), min_size=1, max_size=60))
def test_data_uri_decoding_is_the_standard_librarys(spark, bodies):
    got = column(spark, ["data:text/plain;base64," + b for b in bodies], text.decode_data_uri)
    assert [bytes(g) for g in got] == [lenient(b) for b in bodies]


def test_data_uri_literals(spark):
    bodies = {"aGk=": b"hi", "aGk=@@": b"hi", "@@@": b"", "aGk": b"", "a": b"", "aGk=aGk=": b"hi", "": b""}
    assert [bytes(g) for g in column(spark, [f"data:x;base64,{b}" for b in bodies], text.decode_data_uri)] == list(bodies.values())
    assert bytes(column(spark, ["no comma"], text.decode_data_uri)[0]) == b""


@FEW
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=20))
def test_data_uri_round_trip(spark, contents):
    uris = column(spark, contents, lambda c: text.data_uri(c, F.lit(None).cast("string")), "binary")
    assert uris == ["data:application/octet-stream;base64," + base64.b64encode(c).decode() for c in contents]
    assert [bytes(g) for g in column(spark, uris, text.decode_data_uri)] == contents


def test_url_extension_is_pathlibs(spark):
    paths = ["/a.mp3", "/.html", "/a..b", "/a.b/", "/a.", "", "/d.e/f", "/x.tar.gz?y=.z#.q", "/a b.c"]
    urls = [f"http://host.example{p}" for p in paths]
    assert column(spark, urls, text.url_extension) == [pathlib.PurePosixPath(urlparse(u).path).suffix or ".audio" for u in urls]


def srt(seconds):
    d = datetime.timedelta(seconds=seconds)
    h, rest = divmod(d.seconds, 3600)
    return f"{h:02}:{rest // 60:02}:{rest % 60:02},{d.microseconds // 1000:03}"


@FEW
@given(st.lists(st.integers(0, 10**9).map(lambda x: x / 1000), min_size=1, max_size=50))
def test_srt_time(spark, values):
    assert column(spark, values, text.srt_time, "double") == [srt(v) for v in values]


def test_srt_literals(spark):
    assert column(spark, [3661.042, 86400.0, 0.9999999], text.srt_time, "double") == ["01:01:01,042", "00:00:00,000", "00:00:01,000"]


def test_names(spark):
    assert column(spark, [0, 37, 12345], text.chunk_name, "int") == ["chunk_0000.wav", "chunk_0037.wav", "chunk_12345.wav"]
    assert column(spark, ["a.pdf", "d.x/a", "d/.hidden", "a.b.c"], text.markdown_path) == ["a.md", "d.x/a.md", "d/.hidden.md", "a.b.md"]
    assert column(spark, ["u"], lambda c: text.client_reference(c, F.lit(None).cast("int"))) == ["u"]
    assert column(spark, ["u"], lambda c: text.client_reference(c, F.lit(3))) == ["u:3"]
    assert column(spark, ["", None, "x"], lambda c: text.or_default(c, F.lit("d"))) == ["d", "d", "x"]


@pytest.mark.parametrize(
    "content, kind, way",
    [
        (b"%PDF-1.7", "application/pdf", "ocr"),
        (b"\xff\xd8\xff\xe0", "image/jpeg", "ocr"),
        (b"PK\x03\x04....", "application/zip", "archive"),
        (b"PK\x05\x06" + b"\x00" * 18, "application/zip", "archive"),
        (b"PK\x03\x04" + b"\x00" * 30 + b"word/document.xml", mime.DOCX, "direct"),
        (b"PK\x03\x04" + b"\x00" * 30 + b"ppt/slides", mime.PPTX, "direct"),
        (b"\x00" * 257 + b"ustar", "application/x-tar", "archive"),
        (b"<HTML><body>", "text/html", "direct"),
        (b"plain", "text/plain", "direct"),
        (b"\x00\x01", "application/octet-stream", "direct"),
        (b"", "application/x-empty", "direct"),
        (None, "application/x-empty", "direct"),
    ],
)
def test_types_and_routes(spark, content, kind, way):
    assert column(spark, [content], mime.sniff, "binary") == [kind]
    assert column(spark, [kind], mime.route) == [way]


def test_page_units(spark):
    df = spark.createDataFrame([("application/pdf", 7), ("application/pdf", None), ("image/png", 9), ("text/html", 3), (None, 1)], "m string, n long")
    assert [r[0] for r in df.select(mime.page_units(F.col("m"), F.col("n"))).collect()] == [7, 0, 1, 0, 0]
