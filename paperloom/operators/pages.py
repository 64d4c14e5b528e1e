"""Pages of documents: explode, merge in order, count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import mime
from paperloom.functions.text import joined_in_order, normalize_text
from paperloom.sources.office import office_text


def explode_pages(documents: DataFrame, key: str, text: Column, separator: str = "\n") -> DataFrame:
    """key, page_no from 0, content; one row a page."""
    parts = F.transform(F.split(text, separator), lambda content, i: F.struct(i.cast("long").alias("page_no"), content.alias("content")))
    return documents.select(key, F.inline(parts))


def prepare_pages(files: DataFrame, key: str, render: Callable[[], Callable[[bytes], list[bytes]]], convert: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """key, page_no from 0, content, error: a file's pages by its type (key, mime, content).

    PDF files go through `render` (their pages as images), images that are not JPEG through `convert`, JPEG
    images pass; other types have no pages. Both are factories, called once a task; a file that
    fails has one row with its error and no content. Only files that need it reach Python.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rendered, converted = render(), convert()
        for batch in batches:
            for k, (mime_type, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                error = None
                try:
                    found = list(rendered(content)) if mime_type == mime.PDF else [converted(content)]
                except Exception as e:
                    found, error = [None], str(e) or type(e).__name__
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n)), pa.array(range(n), pa.int64()), pa.array(found, pa.binary()), pa.array([error] * n, pa.string())], names=[key, "page_no", "content", "error"])

    needed = F.col("mime").isin([mime.PDF, *mime.CONVERTED_IMAGES])
    made = files.where(needed).select(key, "mime", "content").mapInArrow(run, f"`{key}` {kind}, page_no bigint, content binary, error string")
    passed = files.where("mime = 'image/jpeg'").select(key, F.lit(0).cast("long").alias("page_no"), "content", F.lit(None).cast("string").alias("error"))
    return made.unionByName(passed)


def merge_pages(pages: DataFrame, key: str, text: str = "content", order: str = "page_no") -> DataFrame:
    """One row a document: its pages' texts that are not empty, in order, two line feeds between; and its units, all pages counted.

    Pages of one document meet in one group; documents spread by key.
    """
    return pages.groupBy(key).agg(normalize_text(joined_in_order(F.col(order), F.col(text), "\n\n")).alias("merged"), F.count("*").alias("units"))


def route_outcomes(files: DataFrame, key: str) -> DataFrame:
    """One row a file (content, mime, route), in one pass: archives and pages to recognise go on and are metered; direct files complete.

    A direct file's result is the text of a DOCX or PPTX, empty for other types; one that cannot be
    read is an error. Only office documents reach Python.
    """
    direct = F.col("route") == "direct"
    read = office_text(files.select(key, "mime", "route", F.when(mime.is_direct(F.col("mime")), F.col("content")).alias("content")))
    status = F.when(~direct, F.lit("processing")).when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("completed"))
    return read.select(key, "route", status.alias("task_status"), F.when(direct, F.col("text")).alias("result"), (~direct).alias("metered"))


#: Why a recognition task fails before a model is called.
NO_PAGES, NO_QUOTA = "Failed to prepare pages for file type: ", "insufficient_quota"


def task_outcomes(gated: DataFrame) -> DataFrame:
    """Gated tasks (route, mime, pages, allowed) with task_status, message and metered: rejected tasks stay, as errors."""
    direct, empty = F.col("route") == "direct", F.coalesce("pages", F.lit(0)) == 0
    message = F.when(direct, F.lit(None).cast("string")).when(empty, F.concat(F.lit(NO_PAGES), F.col("mime"))).when(~F.col("allowed"), F.lit(NO_QUOTA))
    status = F.when(direct, F.lit("completed")).when(F.col("message").isNotNull(), F.lit("error")).otherwise(F.lit("processing"))
    return gated.withColumn("message", message).withColumn("task_status", status).withColumn("metered", ~direct & F.col("message").isNull())
