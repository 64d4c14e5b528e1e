"""MIME types by magic bytes, and what is done with each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
PDF = "application/pdf"
#: The types of each route.
CONVERTED_IMAGES = ["image/png", "image/tiff", "image/webp"]
IMAGES = ["image/jpeg", *CONVERTED_IMAGES]
ARCHIVES = ["application/zip", "application/x-zip-compressed", "application/x-bzip2", "application/x-bz2", "application/zstd", "application/gzip", "application/x-gzip", "application/x-tar", "application/x-7z-compressed", "application/x-rar-compressed"]
#: Leading bytes in hexadecimal, and their type.
MAGIC = [
    ("25504446", PDF), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"),
    ("28B52FFD", "application/zstd"), ("377ABCAF271C", "application/x-7z-compressed"), ("526172211A07", "application/x-rar-compressed"),
]
EXTENSIONS = {".pdf": PDF, ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff", ".webp": "image/webp", ".zip": "application/zip", ".tar": "application/x-tar", ".docx": DOCX, ".pptx": PPTX, ".html": "text/html", ".txt": "text/plain", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".json": "application/json"}


def sniff(content: Column, n: int = 8192) -> Column:
    """The type of binary content by its first bytes. Only those are turned into a string, so large contents stay cheap."""
    head = F.substring(content, 1, n)
    start = F.hex(F.substring(content, 1, 16))
    latin = F.decode(head, "ISO-8859-1")
    out = F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit("application/x-empty"))
    for magic, mime in MAGIC:
        out = out.when(F.startswith(start, F.lit(magic)), F.lit(mime))
    is_zip = F.startswith(start, F.lit("504B0304")) | F.startswith(start, F.lit("504B0506"))
    out = out.when(F.startswith(start, F.lit("52494646")) & (F.substring(start, 17, 8) == "57454250"), F.lit("image/webp"))
    out = out.when(is_zip & F.contains(latin, F.lit("word/")), F.lit(DOCX)).when(is_zip & F.contains(latin, F.lit("ppt/")), F.lit(PPTX)).when(is_zip, F.lit("application/zip"))
    out = out.when(F.substring(latin, 258, 5) == "ustar", F.lit("application/x-tar"))
    out = out.when(F.startswith(F.lower(F.substring(latin, 1, 14)), F.lit("<!doctype html")) | F.startswith(F.lower(F.substring(latin, 1, 5)), F.lit("<html")), F.lit("text/html"))
    return out.when(F.rlike(latin, F.lit(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]")), F.lit("application/octet-stream")).otherwise(F.lit("text/plain"))


def is_docx(mime: Column) -> Column:
    return mime == DOCX


def is_pptx(mime: Column) -> Column:
    return mime == PPTX


def is_pdf(mime: Column) -> Column:
    return mime == PDF


def is_image(mime: Column) -> Column:
    return mime.isin(IMAGES)


def is_ocr_required(mime: Column) -> Column:
    return mime.isin([PDF, *IMAGES])


def is_compressed(mime: Column) -> Column:
    return mime.isin(ARCHIVES)


def is_direct(mime: Column) -> Column:
    return mime.isin([DOCX, PPTX])


def route(mime: Column) -> Column:
    """archive, ocr or direct, tested in that order; a missing type is direct."""
    return F.when(is_compressed(mime), F.lit("archive")).when(is_ocr_required(mime), F.lit("ocr")).otherwise(F.lit("direct"))


def page_units(mime: Column, n_pages: Column) -> Column:
    """Pages that a file is billed for: those of a PDF, 1 for an image, else 0."""
    return F.when(is_pdf(mime), F.coalesce(n_pages, F.lit(0))).when(is_image(mime), F.lit(1)).otherwise(F.lit(0)).cast("long")


def extension_mime(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit("application/octet-stream"))
