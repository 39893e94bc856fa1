"""The crawl frontier as a table: what is queued, seen and visited, and what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_checkpoints(df: DataFrame) -> DataFrame:
    """Frontier rows of repaired checkpoints (columns session_id, c)."""
    queued = df.select("session_id", F.posexplode("c.queued").alias("ord", "url")).select(
        "session_id", "url", F.lit("queued").alias("state"), F.col("ord").cast("bigint").alias("ord"),
        F.lit(0).cast("bigint").alias("depth"), F.lit("other").alias("page_type"),
        F.lit(10).cast("bigint").alias("priority"))
    visited = df.select("session_id", F.explode("c.visited").alias("url"), F.lit("visited").alias("state"))
    return queued.unionByName(visited, allowMissingColumns=True)
