"""Queries on files: written from rows, fetched by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.catalog import query, table
from paperloom.functions import text
from paperloom.sources import fetch, file_sink, files
from paperloom.sources.staging import staging_folder


@query("SELECT source || '/' || lang || '/d' || cast(doc_id AS VARCHAR) || '.md' AS path, cast(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts laid out as Markdown files in folders, and the files read again."""
    folder = staging_folder(spark, "md-files")
    named = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    written = file_sink.write_markdown(table(spark, sf_dir, "documents").select(text.markdown_path(named).alias("out_path"), "text"), folder)
    return files.read_listed(written, folder).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("""
SELECT page_id, CASE WHEN page_id % 10 < 7 OR page_id % 10 = 9 THEN 200 END AS status, CASE WHEN page_id % 10 < 7 THEN sha256(html) WHEN page_id % 10 = 9 THEN sha256(url) END AS sha256,
  CASE page_id % 10 WHEN 7 THEN 'URLError' WHEN 8 THEN 'ValueError' END AS failure FROM pages
""")
def fetched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose addresses are files that pages were written to, data, a missing file, or an unknown kind of address."""
    pages = table(spark, sf_dir, "pages")
    kind, name = F.col("page_id") % 10, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    written = file_sink.write_files(pages.select(name.alias("path"), "html"), staging_folder(spark, "pages"), content="html")
    named = pages.select("page_id", "url", name.alias("path")).join(written.select("path", F.col("url").alias("place")), "path")
    inline = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("url", "UTF-8")))
    address = F.when(kind == 7, F.concat("place", F.lit(".missing"))).when(kind == 8, F.concat(F.lit("gopher://"), "path")).when(kind == 9, inline).otherwise(F.col("place"))
    done = fetch.with_content(named.select("page_id", address.alias("file_url")))
    return done.select("page_id", "status", F.sha2("content", 256).alias("sha256"), F.regexp_extract("error", "^([A-Za-z]+)", 1).alias("failure"))
