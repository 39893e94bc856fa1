"""Filtered, sorted, paged lists. Every sort ends with the key, so pages never overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States a company or batch can be in.
COMPANY_STATUS = ["pending", "in_progress", "completed", "failed", "paused"]
BATCH_STATUS = ["pending", "processing", "completed", "cancelled", "paused"]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, max_size: int | None = None) -> DataFrame:
    """One page; Spark keeps only its rows per task (take-ordered), it does not sort the table.

    ``max_size`` is the caller's limit on what may be asked for.
    """
    number, size = max(1, number), max(1, size) if max_size is None else min(max(1, size), max_size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def totals(df: DataFrame, size: int = 20) -> DataFrame:
    size = max(1, size)
    pages = F.when(F.col("total") > 0, F.ceil(F.col("total") / size)).otherwise(1).cast("bigint")
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", pages)


def companies(df: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    if status in COMPANY_STATUS:
        df = df.filter(F.col("status") == status)
    if search:
        like = f"%{search}%"
        df = df.filter(F.col("company_name").ilike(like) | F.col("website_url").ilike(like))
    return df


def sort_keys(df: DataFrame, field: str, direction: str, key: str, default: str = "created_at") -> list[Column]:
    c = F.col(field if field in df.columns else default)
    # Nulls stand where the reference database puts them: lowest.
    return [c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last(), F.col(key).asc()]


def entities(df: DataFrame, company_id: str, entity_type: str | None = None, min_confidence: float | None = None):
    df = df.filter(F.col("company_id") == company_id)
    if entity_type:
        df = df.filter(F.col("entity_type") == entity_type)
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= min_confidence)
    return df


def pages(df: DataFrame, company_id: str, page_type: str | None = None) -> DataFrame:
    df = df.filter(F.col("company_id") == company_id)
    return df.filter(F.col("page_type") == page_type) if page_type else df


def expired_batches(batches: DataFrame, now: Column, days: int = 7) -> DataFrame:
    done = F.col("status").isin("completed", "cancelled")
    return batches.filter(done & (F.col("completed_at") < now - F.expr(f"INTERVAL {days} DAYS")))
