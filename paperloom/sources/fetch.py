"""Contents behind addresses as rows: http, https, ftp, file and data, one fetch for each distinct address.

A full path (`/folder/name`) is a file's address too, so whatever `file_sink` returns for a folder can be fetched.

Distinct addresses are dealt over tasks; a task has some requests under way at a time and tries
failed ones again later. Bytes are read in pieces, and redirects are followed. The answer's status is a column: as
with a plain client, an error page is content too, unless `check` makes it an error. An address
that gives no answer is a row with its error, never an exception.

Scale: addresses are shuffled, contents are not until they are joined with the rows that ask for them.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom.concurrent import Retry, call_all
from paperloom.functions.text import decode_data_uri
from paperloom.sources.file_sink import open_folder

FETCHED = "url string, status int, content binary, error string"
SCHEMES = ("http", "https", "ftp", "file", "hdfs", "s3", "gs")
#: Of these, the ones that pyarrow's file systems open.
_STORED = {"hdfs", "s3", "gs"}
_PIECE = 1 << 20
#: Answers after which a later attempt may do better.
_LATER = {408, 425, 429, 500, 502, 503, 504}


class TooLarge(ValueError):
    pass


def _open_stored(url: str) -> pa.NativeFile:
    system, path = open_folder(url)
    try:
        return system.open_input_stream(path)
    except OSError as e:  # as for the other schemes
        raise urllib.error.URLError(e) from e


def fetch(url: str, timeout: float = 30, max_bytes: int | None = None, check: bool = False, schemes: Sequence[str] = SCHEMES) -> tuple[int, bytes]:
    """Status (200 where the scheme has none) and content of one address."""
    path = url.startswith("/")
    scheme = "file" if path else url.partition(":")[0].lower()
    if scheme not in schemes:
        raise ValueError("unsupported address")
    try:
        answer = _open_stored(url) if path or scheme in _STORED else urllib.request.urlopen(url, timeout=timeout)
    except urllib.error.HTTPError as e:
        if check or e.code in _LATER:
            raise
        answer = e
    with answer:
        pieces, size = [], 0
        while piece := answer.read(_PIECE):
            size += len(piece)
            if max_bytes is not None and size > max_bytes:
                raise TooLarge(f"over {max_bytes} bytes")
            pieces.append(piece)
        return getattr(answer, "status", None) or 200, b"".join(pieces)


def _answers(urls: list[str], retry: Retry, concurrency: int, **how: object) -> pa.RecordBatch:
    found = call_all(lambda u: fetch(u, **how), [(u,) for u in urls], concurrency, retry)
    status, content, errors = [], [], []
    for answer, error in found:
        code = answer[0] if answer else getattr(error, "code", None)
        status.append(code)
        content.append(answer[1] if answer else None)
        errors.append(None if error is None else f"{type(error).__name__}: {error}")
    return pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(status, pa.int32()), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["url", "status", "content", "error"])


def _runs(urls: list[str], batch_urls: int) -> Iterator[list[str]]:
    for low in range(0, len(urls), batch_urls):
        yield urls[low : low + batch_urls]


def fetch_urls(rows: DataFrame, url: str = "url", timeout: float = 30, max_bytes: int | None = None, check: bool = False, schemes: Sequence[str] = SCHEMES, concurrency: int = 10, retry: Callable[[], Retry] = Retry, partitions: int | None = None, batch_urls: int = 64) -> DataFrame:
    """url, status, content, error: one row for each distinct address that is not null or empty. `data:` addresses are decoded without a request.

    Where strangers give the addresses, pass schemes=("http", "https"): others reach what the tasks can read.
    """
    wanted = rows.select(F.col(url).cast("string").alias("url")).where("url <> ''").distinct()
    inline = F.startswith("url", F.lit("data:"))
    decoded = wanted.where(inline).select("url", F.lit(200).alias("status"), decode_data_uri(F.col("url")).alias("content"), F.lit(None).cast("string").alias("error"))
    remote = wanted.where(~inline)
    if partitions:
        remote = remote.repartition(partitions, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = retry()
        for batch in batches:
            for urls in _runs(batch.column(0).to_pylist(), batch_urls):
                yield _answers(urls, again, concurrency, timeout=timeout, max_bytes=max_bytes, check=check, schemes=schemes)

    return remote.mapInArrow(run, FETCHED).unionByName(decoded)


def with_content(tasks: DataFrame, url: str = "file_url", **how: object) -> DataFrame:
    """Tasks with status, content and error of their addresses; tasks of one address share one fetch. No address, no content."""
    found = fetch_urls(tasks, url, **how).withColumnRenamed("url", "\tfetched")
    return tasks.join(found, F.col(url).cast("string") == F.col("\tfetched"), "left").drop("\tfetched")


class UrlReader(DataSourceReader):
    """Partitions are row groups of a Parquet table of addresses; the driver reads only their numbers."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.column = options["path"], options.get("column", "url")
        self.how = {"timeout": float(options.get("timeout", 30)), "max_bytes": int(options["maxbytes"]) if "maxbytes" in options else None, "check": options.get("check", "false") == "true", "schemes": options.get("schemes", ",".join(SCHEMES)).split(",")}
        self.concurrency, self.attempts, self.delay = int(options.get("concurrency", 10)), int(options.get("attempts", 1)), float(options.get("delay", 0))

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector, FileType

        system, base = open_folder(self.folder)
        one = system.get_file_info(base)
        listed = [one] if one.type == FileType.File else system.get_file_info(FileSelector(base, recursive=True))
        files = [f.path for f in listed if f.type == FileType.File and f.path.endswith(".parquet")]
        return [InputPartition((f, g)) for f in sorted(files) for g in range(pq.ParquetFile(f, filesystem=system).num_row_groups)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, _ = open_folder(self.folder)
        path, group = partition.value
        retry = Retry(self.attempts, self.delay, jitter=0.5)
        for batch in pq.ParquetFile(path, filesystem=system).iter_batches(1024, [group], [self.column]):
            for urls in _runs([u for u in dict.fromkeys(batch.column(0).to_pylist()) if u], 64):
                yield _answers(urls, retry, self.concurrency, **self.how)


class UrlSource(DataSource):
    """`spark.read.format("paperloom_urls").option("path", table).option("column", "url")`: each slice of the table fetched as it is read.

    Other options: timeout, maxBytes, check, schemes (comma-separated), concurrency, attempts, delay. Addresses are fetched once a slice.
    """

    @classmethod
    def name(cls) -> str:
        return "paperloom_urls"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: object) -> UrlReader:
        return UrlReader({k.lower(): v for k, v in self.options.items()})
