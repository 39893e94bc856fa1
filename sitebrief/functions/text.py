"""Page and text columns."""

from __future__ import annotations

import html as html_lib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from sitebrief.functions.batches import each
from sitebrief.functions.markup import parts
from sitebrief.functions.urls import JAVA_WS, let, strip

_ANY_HREF = "(?i)href=[\"']([^\"']+)[\"']"


def _each(kind: str, arrow: pa.DataType, fn):
    """A column function that runs over Arrow batches; null gives null."""
    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return each(values, arrow, lambda v: None if v is None else fn(v))
    return run


def unescape(c: Column) -> Column:
    """All character references, named and numeric."""
    return _each("string", pa.string(), html_lib.unescape)(c)


@F.arrow_udf(StructType().add("title", "string").add("text", "string").add("links", ArrayType(StringType())))
def _page_parts(pages: pa.Array) -> pa.Array:
    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))])
    return each(pages, kind, lambda p: None if p is None else dict(zip(("title", "text", "links"), parts(p))))


def page_parts(html: Column) -> Column:
    """Title, text and link targets of a page, read once."""
    return _page_parts(html)


def title(html: Column) -> Column:
    return page_parts(html)["title"]


def visible_text(html: Column) -> Column:
    """Text nodes outside script, style and noscript, each stripped, joined by one space."""
    return page_parts(html)["text"]


def anchor_hrefs(html: Column) -> Column:
    """Targets of ``<a href>`` in document order, duplicates kept; title and text stay where they were read."""
    return _each("array<string>", pa.list_(pa.string()), lambda p: parts(p)[2])(html)


def all_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_ANY_HREF), 1)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{JAVA_WS}+", " ")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the hash of the text in lower case with single spaces."""
    return F.substring(F.sha2(collapse(F.lower(strip(text))), 256), 1, 16)


def raw_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def clean(text: Column) -> Column:
    return strip(F.regexp_replace(collapse(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def is_meaningful(text: Column, min_words: int = 20) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[a-zA-Z]{3,}")) >= min_words, F.lit(False))


def snippet(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    """Text around ``[start, end)`` (counted from 0), widened to white space, with dots where cut."""
    half = width // 2
    left, right = F.greatest(start - half, F.lit(0)), F.least(end + half, F.length(text))
    before, after = F.substring(text, F.lit(1), left), F.substring(text, right + 1, F.length(text))
    edges = F.struct(
        (left - F.length(F.regexp_extract(F.reverse(before), r"^[^ \n\t]*", 0))).alias("l"),
        (right + F.length(F.regexp_extract(after, r"^[^ \n\t]*", 0))).alias("r"))

    def cut(x):
        body = F.substring(text, x["l"] + 1, x["r"] - x["l"])
        return strip(F.concat(F.when(x["l"] > 0, F.lit("...")).otherwise(""), body,
                              F.when(x["r"] < F.length(text), F.lit("...")).otherwise("")))

    return let(edges, cut)


def html_escape(c: Column) -> Column:
    # The five characters and their references.
    for char, ref in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def safe_name(name: Column) -> Column:
    """A name fit for a download header: no separators, control characters or quotes, 200 long."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]", "_"), r"[\x00-\x1f\x7f\"']", "")
    stem, ext = F.regexp_extract(n, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(n, r"(?s)^(.*)\.([^.]*)$", 2)
    short = F.when(
        n.contains("."), F.concat(F.substring(stem, 1, 195), F.lit("."), F.substring(ext, 1, 4))
    ).otherwise(F.substring(n, 1, 200))
    n = F.when(F.length(n) > 200, short).otherwise(n)
    return F.when(strip(n) == "", F.lit("download")).otherwise(n)


def export_name(name: Column, length: int | None = None) -> Column:
    """A name fit for an export file, cut to ``length`` if given."""
    plain = F.regexp_replace(name, r"[ /\\]", "_")
    return plain if length is None else F.substring(plain, 1, length)
