"""Link graph: depth of each page from the start page of its site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.session import cut_lineage


def link_depth(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """(site, url, depth) by breadth-first search over (site, src, dst) edges, at most max_depth steps.

    Each level is one join of the newest pages with the edges, reduced to distinct targets
    before the shuffle, minus what is known. Levels and edges are checkpointed, so the plan does not grow and
    edges are worked out once.
    """
    front = cut_lineage(starts.select("site", "url").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    known, out = front, cut_lineage(edges.select("site", F.col("src").alias("url"), "dst").distinct())
    for level in range(1, max_depth + 1):
        step = front.select("site", "url").join(out, ["site", "url"]).select("site", F.col("dst").alias("url")).distinct()
        step = step.join(known.select("site", "url"), ["site", "url"], "left_anti")
        front = cut_lineage(step.withColumn("depth", F.lit(level).cast("bigint")))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known
