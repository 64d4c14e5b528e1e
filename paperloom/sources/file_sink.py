"""Rows laid out as single files, each with an address: a data source writer with a two-phase commit.

Tasks write their files below a temporary folder, under names of their own attempt, with a list of
what each stands for. When all tasks have ended, the driver notes which attempts count: one line a
task. A second job then moves the files of those attempts to their places. Both steps can be
repeated: an attempt that did not win is never published, and a file that is already in its place stays.

Folders are anything that pyarrow's file systems open (a path, file:, s3:, gs:, hdfs:).

Scale: nothing but a line a task passes the driver; files move in as many tasks as wrote them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from paperloom.functions.text import or_default
from paperloom.sources.archives import is_safe

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem

ROWS = "path string, content binary"
MANIFEST = "path string, url string, n_bytes long"
_LIST = pa.schema([("path", pa.string()), ("staged", pa.string()), ("n_bytes", pa.int64())])


def open_folder(folder: str) -> tuple[FileSystem, str]:
    from pyarrow.fs import FileSystem

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    system, path = FileSystem.from_uri(folder)
    return system, path.rstrip("/")


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    n_files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str) -> None:
        self.folder, self.temporary = folder, f"_temporary/{job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        import pyarrow.parquet as pq

        system, base = open_folder(self.folder)
        name, n = uuid.uuid4().hex, 0
        place = f"{base}/{self.temporary}/{name}"
        system.create_dir(place, recursive=True)
        with pq.ParquetWriter(f"{place}/list.parquet", _LIST, filesystem=system) as listed:
            for batch in iterator:
                paths, sizes, staged = batch.column(0).to_pylist(), [], []
                for path, content in zip(paths, batch.column(1)):
                    if path is None or not is_safe(path):
                        raise ValueError(f"not a path below the folder: {path!r}")
                    data = b"" if content.as_py() is None else content.as_py()
                    with system.open_output_stream(f"{place}/{n}") as out:
                        out.write(data)
                    staged.append(f"{place}/{n}")
                    sizes.append(len(data))
                    n += 1
                listed.write_batch(pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(staged, pa.string()), pa.array(sizes, pa.int64())], schema=_LIST))
        return Attempt(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_folder(self.folder)
        with system.open_output_stream(f"{base}/{self.temporary}/committed") as out:
            for m in messages:
                if m is not None:
                    out.write(json.dumps({"attempt": m.name, "n_files": m.n_files}).encode() + b"\n")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_folder(self.folder)
        for m in messages:
            if m is not None:
                system.delete_dir(f"{base}/{self.temporary}/{m.name}")


class FileSink(DataSource):
    """Options: path (the folder) and job (a name of this write)."""

    @classmethod
    def name(cls) -> str:
        return "paperloom_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options["job"])


def _publish(folder: str, job: str, address: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileType

        system, base = open_folder(folder)
        made: set[str] = set()
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                with pq.ParquetFile(f"{base}/_temporary/{job}/{attempt}/list.parquet", filesystem=system) as listed:
                    for part in listed.iter_batches(4096):
                        for path, staged in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                            final = f"{base}/{path}"
                            parent = final.rsplit("/", 1)[0]
                            if parent not in made:
                                system.create_dir(parent, recursive=True)
                                made.add(parent)
                            if system.get_file_info(staged).type == FileType.File:
                                system.move(staged, final)
                            elif system.get_file_info(final).type != FileType.File:
                                raise FileNotFoundError(f"{path} was neither staged nor published")
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f"{address}/{p}" for p in part.column(0).to_pylist()], pa.string()), part.column(2)], names=["path", "url", "n_bytes"])

    return run


def publish(spark: SparkSession, folder: str, job: str, url_base: str | None = None) -> DataFrame:
    """path, url, n_bytes of the files of a committed write, moved to their places; a repetition changes nothing."""
    where = f"{folder.rstrip('/')}/_temporary/{job}"
    attempts = spark.read.schema("attempt string, n_files long").json(f"{where}/committed").where("n_files > 0")
    n = max(1, attempts.count())
    published = attempts.select("attempt").repartition(n).mapInArrow(_publish(folder, job, (url_base or folder).rstrip("/")), MANIFEST)
    published.write.mode("overwrite").parquet(f"{where}/manifest")  # files move once, however often the manifest is read
    return spark.read.schema(MANIFEST).parquet(f"{where}/manifest")


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content", url_base: str | None = None) -> DataFrame:
    """Each row's content as the file `folder`/`path`; path, url and n_bytes of all.

    Paths are distinct, relative and stay below the folder, else the write fails before any file is in
    its place. A null content is an empty file. Files of equal path from earlier writes are replaced.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"))
    twice = named.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path").first()
    if twice is not None:
        raise ValueError(f"two rows have the path {twice[0]!r}")
    spark.dataSource.register(FileSink)
    job = uuid.uuid4().hex
    named.write.format(FileSink.name()).option("path", folder).option("job", job).mode("append").save()
    return publish(spark, folder, job, url_base)


def write_markdown(texts: DataFrame, folder: str, path: str = "out_path", text: str = "text", url_base: str | None = None) -> DataFrame:
    """One file a text that is not empty; path, url and n_bytes of all."""
    kept = texts.where(or_default(F.col(text), F.lit(None)).isNotNull())
    return write_files(kept.select(F.col(path).alias("path"), F.encode(text, "UTF-8").alias("content")), folder, url_base=url_base)
