"""Text columns: normalising, data URIs, names and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end, as Python's str.strip sees it.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def normalize_text(text: Column) -> Column:
    """CR LF becomes LF (a lone CR stays), then Unicode white space goes from both ends."""
    return strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def or_default(value: Column, default: Column) -> Column:
    """`value or default`: an empty string counts as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def joined_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: the texts that are not empty, in order, joined; empty where there are none."""
    kept = F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["t"]), separator)


def data_uri(content: Column, mime: Column) -> Column:
    """data:{mime};base64,{content}. Needs spark.sql.chunkBase64String.enabled=false; line breaks are removed in any case."""
    body = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"), body)


def decode_data_uri(uri: Column) -> Column:
    """Bytes after the first comma, by lenient base64; empty where the padding is wrong.

    Foreign characters are skipped; reading stops at the first complete padding; a last group that
    is not complete is an error.
    """
    place = F.instr(uri, ",")
    body = F.when(place > 0, uri.substr(place + 1, F.length(uri))).otherwise(F.lit(""))
    return F.unbase64(_once(F.regexp_replace(body, "[^A-Za-z0-9+/=]", ""), _padded))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _padded(clean: Column) -> Column:
    """What a lenient reader takes of base64 letters and padding, padded to whole groups."""
    # before the first padding, most inputs can be told by length alone
    first = F.instr(clean, "=")
    before = F.when(first > 0, clean.substr(F.lit(1), first - 1)).otherwise(clean)
    over = F.length(before) % 4
    usual = (
        F.when(first == 0, F.when(over == 0, clean).otherwise(F.lit("")))
        .when(over == 3, F.concat(before, F.lit("=")))
        .when((over == 2) & (clean.substr(first + 1, F.lit(1)) == "="), F.concat(before, F.lit("==")))
    )

    def read(state: Column, c: Column) -> Column:
        letter, n = c != "=", F.length(state["kept"]) % 4
        pads = F.when(letter, 0).when(n >= 2, state["pads"] + 1).otherwise(state["pads"])
        done = state["done"] | (~letter & (n >= 2) & (n + pads >= 4))
        kept = F.when(letter & ~state["done"], F.concat(state["kept"], c)).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), F.when(state["done"], state["pads"]).otherwise(pads).alias("pads"), done.alias("done"))

    def finish(state: Column) -> Column:
        kept = state["kept"]
        whole = state["done"] | (F.length(kept) % 4 == 0)
        return F.when(whole, F.rpad(kept, (F.ceil(F.length(kept) / 4) * 4).cast("int"), F.lit("="))).otherwise(F.lit(""))

    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("pads"), F.lit(False).alias("done"))
    return F.coalesce(usual, F.aggregate(F.split(clean, ""), start, read, finish))


def url_extension(url: Column, default: str = ".audio") -> Column:
    """The suffix of the path's last part; none for names that begin with their only dot or end with one."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?|[?#].*$", ""), "/+$", "")
    return or_default(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1), F.lit(default))


def url_is_pdf(url: Column) -> Column:
    return F.endswith(url, F.lit(".pdf"))


def item_url(base: str, kind: str, uid: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.lit(kind), uid)


def client_reference(uid: Column, chunk_id: Column) -> Column:
    """uid:chunk_id, or uid alone."""
    return F.concat_ws(":", uid, chunk_id.cast("string"))


def chunk_name(chunk_id: Column, suffix: str = "wav") -> Column:
    return F.format_string(f"chunk_%04d.{suffix}", chunk_id)


def markdown_path(path: Column) -> Column:
    """The last suffix replaced by .md."""
    return F.concat(F.regexp_replace(path, r"([^/])\.[^./]+$", "$1"), F.lit(".md"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; rounded to microseconds, cut to milliseconds, hours without days."""
    micros = F.round(seconds * 1e6).cast("long")
    millis = F.floor(micros / F.lit(1000)).cast("long")
    s = F.floor(millis / F.lit(1000)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long") % 24, F.floor(s / 60).cast("long") % 60, s % 60, millis % 1000)
