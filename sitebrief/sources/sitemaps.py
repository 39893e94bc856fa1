"""Sitemap XML texts as URL tables, and their expansion from index files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.functions.extract import explode_rows
from sitebrief.functions.scalars import lastmod
from sitebrief.functions.urls import strip
from sitebrief.operators.chunks import running
from sitebrief.session import cut_lineage

_SCHEMA = (
    "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>, sitemap array<struct<loc:string>>"
)


def with_parsed(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds kind (urlset, index or null), urls and children. Broken XML and other roots give none."""
    head = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:\w+:)?(\w+)([^>]*)>", 1)
    attrs = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:\w+:)?(\w+)([^>]*)>", 2)
    parsed = F.from_xml(F.col(xml), _SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    df = df.withColumn("_x", parsed).withColumn("_root", head).withColumn("_ns", attrs.contains("xmlns"))
    loc = F.filter(F.transform("_x.url", lambda u: F.struct(
        strip(u["loc"]).alias("url"), u["lastmod"].alias("lastmod"), u["changefreq"].alias("changefreq"),
        u["priority"].alias("priority"))), lambda u: F.coalesce(u["url"] != "", F.lit(False)))
    df = df.withColumn("_urls", loc).withColumn("_keys", F.col("_urls.url"))
    # Entries without a namespace are dropped when their URL came before.
    urls = F.when(F.col("_ns"), F.col("_urls")).otherwise(
        F.filter("_urls", lambda u, i: F.array_position(F.col("_keys"), u["url"]) == i + 1))
    kids = F.filter(F.transform("_x.sitemap", lambda s: strip(s["loc"])), lambda s: F.coalesce(s != "", F.lit(False)))
    df = df.withColumn("_kids", kids)
    children = F.when(F.col("_ns"), F.col("_kids")).otherwise(F.array_distinct("_kids"))
    return (
        df.withColumn("kind", F.when(F.col("_root") == "urlset", "urlset").when(F.col("_root") == "sitemapindex", "index"))
        .withColumn("urls", F.when(F.col("kind") == "urlset", urls))
        .withColumn("children", F.when(F.col("kind") == "index", children))
        .drop("_x", "_root", "_ns", "_urls", "_keys", "_kids")
    )


def urls_table(df: DataFrame) -> DataFrame:
    """(sitemap_url, pos, url, lastmod, changefreq, priority), one row per entry."""
    rows = explode_rows(with_parsed(df), "urls", ["sitemap_url"])
    return rows.select(
        "sitemap_url", F.col("_pos").cast("bigint").alias("pos"), "_col.url",
        lastmod(strip(F.col("_col.lastmod"))).alias("lastmod"), F.col("_col.changefreq").alias("changefreq"),
        strip(F.col("_col.priority")).try_cast("double").alias("priority"))


def expand(docs: DataFrame, roots: DataFrame, max_files: int | None = None,
           max_urls: int | None = None) -> DataFrame:
    """URLs reached from each root file (column root), in the order a queue would meet them.

    One round per level of index files; a root handles each file once. The caller can limit the files
    and the URLs of a root. What is kept between rounds is the list of handled files, never the documents.
    """
    # Index files are parsed once, to (file, child) rows.
    links = cut_lineage(explode_rows(with_parsed(docs), "children", ["sitemap_url"]))
    level = roots.select("root", F.col("root").alias("sitemap_url"), F.lit(1).cast("bigint").alias("ord"))
    done = cut_lineage(level)
    front = done
    while True:
        kids = front.join(links, "sitemap_url")
        kids = kids.groupBy("root", F.col("_col").alias("sitemap_url")).agg(
            F.min(F.struct("ord", "_pos")).alias("_at"))
        kids = kids.join(done.select("root", "sitemap_url"), ["root", "sitemap_url"], "left_anti")
        used = done.groupBy("root").agg(F.count("*").alias("_used"))
        order = F.row_number().over(W.partitionBy("root").orderBy("_at")) + F.col("_used")
        kids = kids.join(used, "root").withColumn("ord", order.cast("bigint"))
        if max_files is not None:
            kids = kids.filter(F.col("ord") <= max_files)
        front = cut_lineage(kids.select("root", "sitemap_url", "ord"))
        if front.isEmpty():
            break
        done = done.unionByName(front)
    files = done.join(with_parsed(docs).select("sitemap_url", "urls"), "sitemap_url")
    rows = explode_rows(files, "urls", ["root", "ord", "sitemap_url"])
    # A file is a chunk of its root's order, so that a root with very many URLs is not one task.
    rows = running(rows, ["root"], ["ord", "_pos"], F.col("ord"), rank="n")
    if max_urls is not None:
        rows = rows.filter(F.col("n") <= max_urls)
    return rows.select("root", "n", "sitemap_url", F.col("_col.url").alias("url"))
