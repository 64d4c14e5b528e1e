"""Archives: members as rows, and archives written from rows."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZIP = {"application/zip", "application/x-zip-compressed"}
SINGLE = "extracted_file"
MEMBER_FIELDS = "member_no int, member_path string, member binary, error string"


def is_safe(path: str) -> bool:
    return bool(path) and not path.startswith(("/", "\\")) and ".." not in path.replace("\\", "/").split("/")


def _inflate(content: bytes, mime: str, limit: int | None) -> bytes:
    if mime in ("application/gzip", "application/x-gzip"):
        source: io.BufferedIOBase = gzip.GzipFile(fileobj=io.BytesIO(content))
    elif mime in ("application/x-bzip2", "application/x-bz2"):
        source = bz2.BZ2File(io.BytesIO(content))
    else:
        import zstandard

        source = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content))
    return source.read() if limit is None else source.read(limit + 1)


def members(content: bytes | None, mime: str | None, max_member_bytes: int | None = None) -> Iterator[tuple[int, str | None, bytes | None, str | None]]:
    """(number, path, content, error) of each file in the archive, in its order; an error is a row, never an exception. Members over `max_member_bytes`, if given, are errors."""
    limit = float("inf") if max_member_bytes is None else max_member_bytes
    if content is None or mime is None:
        yield 0, None, None, "missing content or type"
        return
    n = 0
    try:
        if mime in ZIP:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    if not is_safe(info.filename):
                        yield n, info.filename, None, "unsafe path"
                    elif info.file_size > limit:
                        yield n, info.filename, None, "member too large"
                    else:
                        yield n, info.filename, z.read(info), None
                    n += 1
        elif mime == "application/x-tar":
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                for info in t:
                    if not info.isfile():
                        continue
                    if not is_safe(info.name):
                        yield n, info.name, None, "unsafe path"
                    elif info.size > limit:
                        yield n, info.name, None, "member too large"
                    else:
                        yield n, info.name, t.extractfile(info).read(), None
                    n += 1
        elif mime in ("application/gzip", "application/x-gzip", "application/x-bzip2", "application/x-bz2", "application/zstd"):
            data = _inflate(content, mime, max_member_bytes)
            n = 1
            yield (0, SINGLE, data, None) if len(data) <= limit else (0, SINGLE, None, "member too large")
        else:
            n = 1
            yield 0, None, None, "unsupported_archive"
    except Exception as e:  # a broken archive is a result
        yield n, None, None, f"{type(e).__name__}: {e}"
        return
    if n == 0:
        yield 0, None, None, "no files"


def explode_archives(files: DataFrame, content: str = "content", mime: str = "mime", max_member_bytes: int | None = None, batch_bytes: int = 1 << 24) -> DataFrame:
    """Each file's other columns with member_no, member_path, member, error; one row a member. Members are not opened again."""
    keep = [c for c in files.columns if c not in (content, mime, "member_no", "member_path", "member", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema), MEMBER_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held: list[tuple] = []
                size = 0

                def flush(k: int = k) -> pa.RecordBatch:
                    no, path, data, error = zip(*held)
                    repeat = pa.array([k] * len(held))
                    return pa.RecordBatch.from_arrays([*(c.take(repeat) for c in batch.columns[: len(keep)]), pa.array(no, pa.int32()), pa.array(path, pa.string()), pa.array(data, pa.binary()), pa.array(error, pa.string())], names=[*keep, "member_no", "member_path", "member", "error"])

                for member in members(batch.column(len(keep))[k].as_py(), batch.column(len(keep) + 1)[k].as_py(), max_member_bytes):
                    held.append(member)
                    size += len(member[2] or b"")
                    if size >= batch_bytes:  # members leave as they come, not an archive at a time
                        yield flush()
                        held.clear()
                        size = 0
                if held:
                    yield flush()

    return files.select(*keep, content, mime).mapInArrow(run, schema)


def zip_members(rows: DataFrame, archive: str, path: str, content: str) -> DataFrame:
    """archive, zipped: a DEFLATE archive of each group's members, sorted by path, with one fixed time, so equal rows give equal bytes."""
    kind = rows.schema[archive].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(group["path"], group["content"])):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({archive: [group[archive].iloc[0]], "zipped": [out.getvalue()]})

    named = rows.select(archive, F.col(path).alias("path"), F.col(content).alias("content")).where("path IS NOT NULL AND content IS NOT NULL")
    return named.groupBy(archive).applyInPandas(pack, f"`{archive}` {kind}, zipped binary")
