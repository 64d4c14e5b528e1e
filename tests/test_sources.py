import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.plans import documents as plans
from paperloom.plans.query_documents import _docx
from paperloom.providers import stub
from paperloom.sources import archives, files, office


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize(
    "content, mime, expected",
    [
        (zipped([("d/", b""), ("d/a.txt", b"1"), ("b", b"2")]), "application/zip", [("d/a.txt", b"1", None), ("b", b"2", None)]),
        (zipped([("../x", b"1"), ("/y", b"2"), ("ok", b"3")]), "application/zip", [("../x", None, "unsafe path"), ("/y", None, "unsafe path"), ("ok", b"3", None)]),
        (zipped([]), "application/zip", [(None, None, "no files")]),
        (tarred([("a/b", b"x")]), "application/x-tar", [("a/b", b"x", None)]),
        (gzip.compress(tarred([("a", b"x")]))[:0] + gzip.compress(b"one"), "application/gzip", [("extracted_file", b"one", None)]),
        (bz2.compress(b"two"), "application/x-bz2", [("extracted_file", b"two", None)]),
        (b"7z...", "application/x-7z-compressed", [(None, None, "unsupported_archive")]),
        (None, "application/zip", [(None, None, "missing content or type")]),
    ],
)
def test_members(content, mime, expected):
    assert [(p, c, e) for _, p, c, e in archives.members(content, mime)] == expected


def test_zstd_and_broken_archives():
    import zstandard

    assert [c for _, _, c, _ in archives.members(zstandard.compress(b"three"), "application/zstd")] == [b"three"]
    (_, _, _, error), *_ = archives.members(b"PK broken", "application/zip")
    assert error.startswith("BadZipFile")


def test_explode_and_zip_again(spark):
    rows = [(1, zipped([("b", b"2"), ("a", b"1")]), "application/zip", "k"), (2, b"?", "application/zip", "k")]
    df = spark.createDataFrame(rows, "task int, content binary, mime string, error string")
    opened = archives.explode_archives(df)
    assert opened.columns == ["task", "member_no", "member_path", "member", "error"] and opened.count() == 3
    packed = archives.zip_members(opened, "task", "member_path", "member").collect()
    again = archives.zip_members(opened.repartition(7), "task", "member_path", "member").collect()
    assert len(packed) == 1 and packed == again
    assert zipfile.ZipFile(io.BytesIO(packed[0].zipped)).namelist() == ["a", "b"]


def _pptx(slides):
    xml = '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">{}</p:sld>'
    shape = "<p:sp><p:txBody>{}</p:txBody></p:sp>"
    return zipped([(f"ppt/slides/slide{n}.xml", xml.format("".join(shape.format("".join(f"<a:p><a:r><a:t>{p}</a:t></a:r></a:p>" for p in s)) for s in shapes))) for n, shapes in slides.items()])


def test_office_text(spark):
    deck = _pptx({10: [["last"]], 2: [["one", "line"], [" "], ["two"]]})
    rows = [(1, _docx(["a", "", " b & c"]), "docx"), (2, deck, "pptx"), (3, b"x", "other"), (4, b"x", "docx")]
    from paperloom.functions import mime

    df = spark.createDataFrame(rows, "k int, content binary, m string").withColumn("mime", F.when(F.col("m") == "docx", mime.DOCX).when(F.col("m") == "pptx", mime.PPTX).otherwise("text/plain"))
    got = {r.k: (r.text, r.error and r.error.split(":")[0]) for r in office.office_text(df).collect()}
    assert got == {1: ("a\n\n b & c", None), 2: ("one\nline\n\ntwo\n\nlast", None), 3: ("", None), 4: (None, "BadZipFile")}


def test_archive_plan(spark):
    inner = zipped([("x", b"1")])
    content = zipped([("a.docx", _docx(["word"])), ("b.jpg", b"\xff\xd8\xffpicture"), ("c.txt", b"plain"), ("d.zip", inner)])
    df = spark.createDataFrame([(1, content, "application/zip")], "task int, content binary, mime string")
    got = {r.member_path: r.text for r in plans.archive_texts(df, "task", stub("seen ")).collect()}
    assert got["a.docx"] == "word" and got["b.jpg"].startswith("seen ") and got["c.txt"] == got["d.zip"] == ""


def test_forms_and_transcripts(spark):
    df = spark.createDataFrame([(1, '{"k": 2}'), (2, "{"), (3, ""), (4, None)], "i int, x string")
    parsed, ok = files.parse_form(F.col("x"), "k int")
    assert {r.i: (r.k, r.ok) for r in df.select("i", parsed["k"].alias("k"), ok.alias("ok")).collect()} == {1: (2, True), 2: (None, False), 3: (None, True), 4: (None, True)}
    payload = '{"format": "2", "job": {"id": "j", "duration": 3}, "metadata": {"language_identification": {"predicted_language": "en"}}, "results": [{"type": "word", "start_time": 0.5, "end_time": 1, "alternatives": [{"content": "hi", "language": "en"}, {"content": "ho"}]}, {"type": "word", "alternatives": []}]}'
    got = files.read_transcripts(spark.createDataFrame([(1, payload)], "t int, payload string"), "t").orderBy("seq").collect()
    assert [(r.seq, r.content, r.job_id, r.duration, r.predicted_language) for r in got] == [(0, "hi", "j", 3, "en"), (1, None, "j", 3, "en")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "a.bin").write_bytes(b"abc")
    assert [bytes(r.content) for r in files.read_files(spark, str(tmp_path / "in")).collect()] == [b"abc"]
    (tmp_path / "p.prompt").write_text("Say\nwhat you see.")
    assert files.read_prompt(spark, str(tmp_path / "p.prompt")) == "Say\nwhat you see."
    for _ in range(2):
        files.append_events(spark.createDataFrame([(1, "init")], "t int, status string"), str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def test_tables_of_files_too_large_for_a_row(spark, sf_dir):
    """The limit lies between the files' sizes: some come as bytes, the others in splits."""
    from paperloom.plans import query_documents

    expected = sorted(map(tuple, query_documents.src_binary(spark, sf_dir).collect()))
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    try:
        for limit in ("20000", "1"):
            spark.conf.set(key, limit)
            assert sorted(map(tuple, query_documents.src_binary(spark, sf_dir).collect())) == expected
    finally:
        spark.conf.set(key, before)
    assert dict(expected)["region.parquet"] == 5 and len(expected) == 14


def test_office_texts_leave_in_small_batches(spark, sf_dir):
    from paperloom.functions import mime
    from paperloom.plans import query_documents

    rows = [(k, _docx(["word"] * k) if k % 3 else b"broken") for k in range(1, 30)] + [(30, None)]
    df = spark.createDataFrame(rows, "k int, content binary").coalesce(1).withColumn("mime", F.lit(mime.DOCX))
    for batch_bytes in (1, 1000, 1 << 22):
        got = {r.k: (r.text, r.error and r.error.split(":")[0]) for r in office.office_text(df, batch_bytes=batch_bytes).collect()}
        assert got.pop(30)[0] is None and got == {k: ("\n\n".join(["word"] * k), None) if k % 3 else (None, "BadZipFile") for k in range(1, 30)}
    assert office.office_text(df.where("false")).count() == 0
    assert "ArrowEvalPython" not in query_documents.slides_text(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
