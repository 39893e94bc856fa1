"""Page tables: scans, links per page, site profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import classify as C
from sitebrief.functions import text as X
from sitebrief.functions import urls as U
from sitebrief.functions.extract import explode_rows


def with_text(pages: DataFrame, company_id: str | None = None) -> DataFrame:
    """Pages that have text, of one company or of all; both tests reach the scan."""
    keep = F.col("text").isNotNull() & (F.col("text") != "")
    if company_id is not None:
        keep = keep & (F.col("company_id") == company_id)
    return pages.filter(keep)


def links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``<a href>`` that resolves to an http(s) URL; html is dropped at once, ``keep`` columns stay."""
    found = explode_rows(pages, X.anchor_hrefs(F.col("html")), ["page_id", "url", *keep])
    link = U.link_resolve(F.col("url"), F.col("_col"))
    return (
        found.select("page_id", *keep, F.col("_pos").cast("bigint").alias("pos"), link.alias("link"))
        .filter(F.col("link").isNotNull())
    )


def hrefs(pages: DataFrame) -> DataFrame:
    """Every href on any tag, each URL once per page, at its first position."""
    forms = F.transform(X.all_hrefs(F.col("html")), lambda h: U.external_form(F.col("url"), h))
    df = pages.select("page_id", forms.alias("all"))
    df = explode_rows(df, F.array_distinct(F.array_compact("all")), ["page_id", "all"])
    return df.withColumnRenamed("_col", "link").select("page_id", "link", (F.array_position("all", F.col("link")) - 1).cast("bigint").alias("pos"))


def site_profile(pages: DataFrame) -> DataFrame:
    """Pages, typed pages, exact copies and links per site.

    Copies are counted as rows minus distinct texts, with two aggregates that both combine
    before their shuffle, so neither a large site nor a text copied a million times is one task.
    """
    # One reading of a page gives its text and its links.
    pages = pages.select("url", X.page_parts(F.col("html")).alias("parts"))
    rows = pages.select(
        F.lower(F.regexp_extract("url", "//([^/?#]+)", 1)).alias("site"),
        C.page_type_first_match(F.col("url")).alias("page_type"),
        X.content_hash(F.col("parts.text")).alias("hash"),
        F.size("parts.links").alias("n_links"),
    )
    per_text = rows.groupBy("site", "hash").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("page_type") != "other").alias("typed"),
        F.sum("n_links").alias("links"),
    )
    return per_text.groupBy("site").agg(
        F.sum("n").alias("pages"),
        F.sum("typed").alias("typed_pages"),
        F.sum(F.col("n") - 1).alias("copies"),
        F.sum("links").alias("links"),
    )
