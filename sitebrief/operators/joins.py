"""Joins between companies, batches, sessions, links and their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import scalars as S
from sitebrief.functions.urls import registry_key


def registry_conflicts(new: DataFrame, companies: DataFrame, url: str = "website_url") -> DataFrame:
    """New rows whose key is registered, with the first registered id."""
    known = companies.groupBy(registry_key(F.col("website_url")).alias("_key")).agg(
        F.min("company_id").alias("existing_id"))
    return new.withColumn("_key", registry_key(F.col(url))).join(known, "_key").drop("_key")


def registry_new(new: DataFrame, companies: DataFrame, url: str = "website_url") -> DataFrame:
    known = companies.select(registry_key(F.col("website_url")).alias("_key"))
    return new.withColumn("_key", registry_key(F.col(url))).join(known, "_key", "left_anti").drop("_key")


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row with the greatest order per key, as a combining aggregate (no sort, no window)."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*")


def company_detail(companies: DataFrame, analyses: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Children are reduced to one row per company before they meet it."""
    last = latest(analyses, "company_id", ["version"], ["version", "executive_summary"])
    n_ent = entities.groupBy("company_id").agg(F.count("*").alias("entity_count"))
    n_page = pages.groupBy("company_id").agg(F.count("*").alias("page_count"))
    out = companies.join(last, "company_id", "left").join(n_ent, "company_id", "left").join(n_page, "company_id", "left")
    return out.fillna(0, ["entity_count", "page_count"])


def cascade_delete(doomed: DataFrame, children: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining rows per child table, and the number of deleted rows per table."""
    ids = doomed.select("company_id").distinct()
    kept = {n: df.join(ids, "company_id", "left_anti") for n, df in children.items()}
    report = None
    for n, df in children.items():
        gone = df.join(ids, "company_id", "left_semi").agg(F.count("*").alias("deleted")).select(
            F.lit(n).alias("table_name"), "deleted")
        report = gone if report is None else report.unionByName(gone)
    return kept, report


def batch_cleanup(companies: DataFrame, expired: DataFrame) -> DataFrame:
    """Members of dropped batches lose their batch id."""
    gone = expired.select("batch_id", F.lit(True).alias("_gone"))
    j = companies.join(gone, "batch_id", "left")
    return j.withColumn("batch_id", F.when(F.col("_gone").isNull(), F.col("batch_id"))).drop("_gone")


def unvisited_links(links: DataFrame, visited: DataFrame, seen: DataFrame) -> DataFrame:
    """Each new link of a site once: neither visited nor queued before."""
    fresh = links.select("site", "link").distinct()
    return fresh.join(visited, ["site", "link"], "left_anti").join(seen, ["site", "link"], "left_anti")


def progress_merge(stored: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Live values win field by field; stored ones fill the gaps."""
    l = live.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = stored.join(l, key, "left")
    return j.select(*[c for c in stored.columns if c not in fields],
                    *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def batch_assign(companies: DataFrame, ids: DataFrame, batch_id: str, config: Column, base: Column) -> DataFrame:
    """Known ids get the batch and the merged config; unknown ids are ignored."""
    j = companies.drop("batch_id").join(ids.select("company_id").distinct(), "company_id")
    return j.withColumn("batch_id", F.lit(batch_id)).withColumn("config", S.merge_config(base, config))


def job_state(companies: DataFrame, sessions: DataFrame) -> DataFrame:
    """Companies with the repaired checkpoint of their newest session, if any."""
    last = latest(sessions, "company_id", ["created_at", "session_id"], ["session_id", "checkpoint"])
    j = companies.join(last, "company_id", "left")
    ck = F.when(F.col("checkpoint").isNotNull(), S.checkpoint(F.col("checkpoint")))
    return j.withColumn("c", ck).drop("checkpoint")
