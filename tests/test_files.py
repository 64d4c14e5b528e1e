"""Files written from rows with a two-phase commit, and contents fetched by address."""

import base64
import http.server
import os
import threading
from collections import Counter

import pyarrow as pa
import pytest

from paperloom.concurrent import Retry
from paperloom.sources import fetch, file_sink

ROWS = [("a/b.md", b"one"), ("a/c/d.md", "zwölf".encode()), ("e.md", None), ("f.md", b"")]


def tree(folder):
    return {os.path.relpath(f"{d}/{n}", folder): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(folder) for n in names if "_temporary" not in d}


def rows(spark, some):
    return spark.createDataFrame(some, "path string, content binary")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_read_back_equal_rows(spark, tmp_path, scheme):
    got = {r.path: (r.url, r.n_bytes) for r in file_sink.write_files(rows(spark, ROWS).repartition(3), f"{scheme}{tmp_path}/out").collect()}
    assert tree(f"{tmp_path}/out") == {p: c or b"" for p, c in ROWS}
    assert got == {p: (f"{scheme}{tmp_path}/out/{p}", len(c or b"")) for p, c in ROWS}


def test_addresses_and_replacement(spark, tmp_path):
    file_sink.write_files(rows(spark, ROWS), str(tmp_path))
    got = file_sink.write_files(rows(spark, [("e.md", b"new")]), str(tmp_path), url_base="https://media.example/")
    assert got.first().url == "https://media.example/e.md"
    assert tree(tmp_path) == {p: c or b"" for p, c in ROWS} | {"e.md": b"new"}


@pytest.mark.parametrize("bad", [[("../x", b"")], [("/x", b"")], [(None, b"")], [("x", b"1"), ("x", b"2")]])
def test_a_write_that_fails_leaves_no_file(spark, tmp_path, bad):
    with pytest.raises(Exception, match="path"):
        file_sink.write_files(rows(spark, ROWS + bad).repartition(2), str(tmp_path))
    assert tree(tmp_path) == {}


def batches(some):
    return iter([pa.record_batch([pa.array([p for p, _ in some], pa.string()), pa.array([c for _, c in some], pa.binary())], names=["path", "content"])])


def test_a_task_that_runs_twice_leaves_one_copy(spark, tmp_path):
    """The first attempt is lost after it wrote; publishing is repeated, also after it had moved a part."""
    writer = file_sink.FileWriter(str(tmp_path), "job")
    writer.write(batches([("a.md", b"lost"), ("z.md", b"lost")]))
    second = writer.write(batches([("a.md", b"kept"), ("b/c.md", b"kept too")]))
    writer.commit([second, None])
    for _ in range(2):
        got = sorted((r.path, r.n_bytes) for r in file_sink.publish(spark, str(tmp_path), "job").collect())
        assert got == [("a.md", 4), ("b/c.md", 8)]
        assert tree(tmp_path) == {"a.md": b"kept", "b/c.md": b"kept too"}
    os.remove(tmp_path / "a.md")
    with pytest.raises(Exception, match="neither staged nor published"):
        file_sink.publish(spark, str(tmp_path), "job").collect()


def test_abort_removes_attempts(tmp_path):
    writer = file_sink.FileWriter(str(tmp_path), "job")
    done = writer.write(batches(ROWS))
    writer.abort([done, None])
    assert os.listdir(tmp_path / "_temporary" / "job") == []


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "xé"), ("b.md", ""), ("c.md", None)], "out_path string, text string")
    assert [(r.path, r.n_bytes) for r in file_sink.write_markdown(df, str(tmp_path)).collect()] == [("a.md", 3)]
    assert file_sink.write_markdown(df.where("false"), str(tmp_path / "none")).count() == 0


class Site(http.server.BaseHTTPRequestHandler):
    seen: Counter = Counter()

    def do_GET(self):
        self.seen[self.path] += 1
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/ok")
            self.end_headers()
            return
        code = 404 if self.path == "/none" else 503 if self.path == "/later" and self.seen[self.path] < 3 else 200
        body = b"x" * 3_000_000 if self.path == "/long" else self.path.encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_site(spark, site, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    urls = [f"{site}/ok", f"{site}/moved", f"{site}/none", f"{site}/later", f"{site}/long", f"file://{tmp_path}/f.bin", f"file://{tmp_path}/none", "data:text/plain;base64," + base64.b64encode(b"hi").decode(), "data:;base64,a", "nowhere", "", None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls + urls[:1] * 50)], "task int, file_url string")
    Site.seen.clear()
    found = fetch.with_content(df, "file_url", max_bytes=1_000_000, retry=lambda: Retry(attempts=3, delay=0.01), partitions=3)
    found.cache()
    got = {r.task: (r.status, None if r.content is None else bytes(r.content), (r.error or "").split(":")[0]) for r in found.collect()}
    assert len(got) == len(urls) + 50 and Site.seen["/ok"] == 2  # once for its 51 tasks, once for the one that was moved
    assert got[0] == got[60] == got[1] == (200, b"/ok", "")
    assert got[2] == (404, b"/none", "") and got[3] == (200, b"/later", "") and Site.seen["/later"] == 3
    assert got[4] == (None, None, "TooLarge")
    assert got[5] == (200, b"abc", "") and got[6][2] == "URLError"
    assert got[7] == (200, b"hi", "") and got[8] == (200, b"", "")
    assert got[9][2] == "ValueError" and got[10] == got[11] == (None, None, "")
    found.unpersist()


def test_checked_status(spark, site):
    df = spark.createDataFrame([(f"{site}/none",)], "url string")
    r = fetch.fetch_urls(df, check=True).first()
    assert (r.status, r.content) == (404, None) and r.error.startswith("HTTPError")
    assert fetch.fetch_urls(df.where("false")).count() == 0


def test_only_schemes_that_are_allowed(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    df = spark.createDataFrame([(f"file://{tmp_path}/f.bin",), (f"FILE://{tmp_path}/f.bin",)], "url string")
    assert {(r.content, r.error) for r in fetch.fetch_urls(df, schemes=("http", "https")).collect()} == {(None, "ValueError: unsupported address")}


def test_a_table_of_addresses_as_a_source(spark, site, tmp_path):
    spark.createDataFrame([(f"{site}/n{k}", k) for k in range(30)] + [(None, 1), (f"{site}/n0", 2)], "link string, k int").repartition(4).write.parquet(f"{tmp_path}/urls")
    spark.dataSource.register(fetch.UrlSource)
    df = spark.read.format("paperloom_urls").option("path", f"{tmp_path}/urls").option("column", "link").option("timeout", "5").load()
    assert df.rdd.getNumPartitions() == 4
    assert {(r.status, bytes(r.content).decode()) for r in df.collect()} == {(200, f"/n{k}") for k in range(30)}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_written_files_are_fetched_by_their_addresses(spark, tmp_path, scheme):
    written = file_sink.write_files(rows(spark, ROWS + [("o.md.missing", b"")]), f"{scheme}{tmp_path}/out")
    os.remove(f"{tmp_path}/out/o.md.missing")
    got = {r.path: (r.status, r.content and bytes(r.content), (r.error or "").split(":")[0]) for r in fetch.with_content(written, "url").collect()}
    assert got == {p: (200, bytes(c or b""), "") for p, c in ROWS} | {"o.md.missing": (None, None, "URLError")}
    refused = fetch.with_content(written, "url", schemes=("http", "https")).collect()
    assert {(r.content, r.error) for r in refused} == {(None, "ValueError: unsupported address")}


def test_fetched_files_without_a_scheme(spark, sf_dir, tmp_path, monkeypatch):
    """The shared folder may be a plain path."""
    from paperloom.plans import query_files

    monkeypatch.setattr(query_files, "staging_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = {r.page_id: (r.status, r.failure) for r in query_files.fetched_files(spark, sf_dir).collect()}
    assert got and all(v == ((None, "URLError") if k % 10 == 7 else (None, "ValueError") if k % 10 == 8 else (200, None)) for k, v in got.items())


def test_listed_files(spark, tmp_path):
    from paperloom.sources import files

    folder = f"file://{tmp_path}/out"
    written = file_sink.write_files(rows(spark, ROWS).repartition(3), folder)
    (tmp_path / "out" / "other.md").write_bytes(b"not listed")
    for batch_bytes in (1, 1 << 22):
        got = {r.path: (r.length, bytes(r.content)) for r in files.read_listed(written, folder, batch_bytes=batch_bytes).collect()}
        assert got == {p: (len(c or b""), c or b"") for p, c in ROWS}
    assert files.read_listed(written.where("false"), folder).count() == 0
    os.remove(tmp_path / "out" / "e.md")
    with pytest.raises(Exception, match="e.md"):
        files.read_listed(written, folder).collect()


def test_markdown_files_are_read_in_few_tasks(spark, sf_dir):
    """Not one task for every few files: opening costs that Spark assumes for a file make 32 of them a partition."""
    from paperloom.plans import query_files

    assert query_files.md_files(spark, sf_dir).rdd.getNumPartitions() <= 4
