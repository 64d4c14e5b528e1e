"""Staged files, request forms and transcripts as tables; results as files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions.text import or_default
from paperloom.sources.file_sink import open_folder


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def read_listed(listed: DataFrame, folder: str, path: str = "path", batch_bytes: int = 1 << 22) -> DataFrame:
    """path, length, content of the files below a folder that rows name, read where the rows are: no folder is listed by the driver, and tasks are as few as the rows have. A missing file fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            contents, size, low = [], 0, 0
            for k in range(batch.num_rows):
                with system.open_input_stream(f"{base}/{batch.column(0)[k].as_py()}") as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= batch_bytes or k + 1 == batch.num_rows:
                    lengths = pa.array([len(c) for c in contents], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(contents)), lengths, pa.array(contents, pa.binary())], names=["path", "length", "content"])
                    contents, size, low = [], 0, k + 1

    return listed.select(F.col(path).cast("string").alias("path")).mapInArrow(run, "path string, length bigint, content binary")


def make_files(rows: DataFrame, keep: Sequence[str], inputs: Sequence[str], make: Callable[..., bytes], batch_bytes: int = 1 << 22) -> DataFrame:
    """The columns `keep`, and content: the bytes that `make` gives for a row's `inputs`. Files leave the task every `batch_bytes`, however many small rows a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size, low = [], 0, 0
            for k in range(batch.num_rows):
                made.append(make(*(c[k].as_py() for c in batch.columns[len(keep) :])))
                size += len(made[-1])
                if size >= batch_bytes or k + 1 == batch.num_rows:
                    kept = [c.slice(low, len(made)) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], names=[*keep, "content"])
                    made, size, low = [], 0, k + 1

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "content binary"])
    return rows.select(*keep, *(F.col(c).alias(f"\tinput{k}") for k, c in enumerate(inputs))).mapInArrow(run, schema)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file's whole text, for a provider's factory to hold."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """name, prompt: all prompt files below a folder, whole."""
    rows = read_files(spark, folder, "*.prompt")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.prompt$", 1).alias("name"), F.decode("content", "UTF-8").alias("prompt"))


def parse_form(text: Column, schema: str) -> tuple[Column, Column]:
    """A JSON form field as a struct, and whether it is acceptable. Empty and missing fields are null and acceptable."""
    given = or_default(text, F.lit(None).cast("string"))
    parsed = F.try_parse_json(given)
    return F.from_json(F.when(parsed.isNotNull(), given), schema), given.isNull() | parsed.isNotNull()


def read_transcripts(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Tokens of JSON transcripts: key, seq, type, times, content and language of the first alternative, job id, duration, predicted language."""
    schema = schemas.TRANSCRIPT.removeprefix("STRUCT<").removesuffix(">")
    read, row = F.col("\tread"), F.col("\trow")
    typed = payloads.select(key, F.from_json(payload, f"struct<{schema}>").alias("\tread"))
    rows = typed.select(key, read["job"]["id"].alias("job_id"), read["job"]["duration"].alias("duration"), read["metadata"]["language_identification"]["predicted_language"].alias("predicted_language"), F.posexplode(read["results"]).alias("seq", "\trow"))
    first = F.get(row["alternatives"], F.lit(0))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), row["type"].alias("type"), row["start_time"].alias("start_time"), row["end_time"].alias("end_time"), first["content"].alias("content"), first["language"].alias("language"), "job_id", "duration", "predicted_language")


def append_events(events: DataFrame, folder: str) -> None:
    """State changes are appended; the latest one of a task is its state."""
    events.write.mode("append").parquet(folder)
