"""Running windows that keep working when one key holds most of the rows.

A plain window sends all rows of a key to one task. Here each key is first cut into chunks
along the order (a minute, a block of ids), windows run per chunk, and the chunk totals, one row
per chunk, carry ranks, sums and neighbours across the borders. Chunks are computed from the
row itself, so a task that is run again cuts in the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
) -> DataFrame:
    """Add row number, running sums and neighbour values per key.

    ``order`` must be unique per key, and ``chunk`` must not fall as ``order`` rises.
    """
    sums, lags, leads = sums or {}, lags or {}, leads or {}
    df = df.withColumn("_chunk", chunk)
    at = F.struct(*order)
    totals = [F.count("*").alias("_n")]
    totals += [F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()]
    totals += [F.max_by(F.struct(e.alias("v")), at).alias(f"_last_{n}") for n, e in lags.items()]
    totals += [F.min_by(F.struct(e.alias("v")), at).alias(f"_first_{n}") for n, e in leads.items()]
    per_chunk = df.groupBy(*keys, "_chunk").agg(*totals)

    across = W.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")]
    carried += [F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum0_{n}") for n in sums]
    carried += [F.lag(f"_last_{n}").over(across).alias(f"_lag0_{n}") for n in lags]
    carried += [F.lead(f"_first_{n}").over(across).alias(f"_lead0_{n}") for n in leads]
    per_chunk = per_chunk.select(*keys, "_chunk", *carried)

    local = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    inside = [F.row_number().over(local).alias("_rn")]
    inside += [F.sum(e).over(upto).alias(f"_s_{n}") for n, e in sums.items()]
    inside += [F.lag(F.struct(e.alias("v"))).over(local).alias(f"_lag_{n}") for n, e in lags.items()]
    inside += [F.lead(F.struct(e.alias("v"))).over(local).alias(f"_lead_{n}") for n, e in leads.items()]
    rows = df.select("*", *inside).join(per_chunk, [*keys, "_chunk"])

    out = [c for c in df.columns if c != "_chunk"]
    added = []
    if rank:
        added.append((F.col("_n0") + F.col("_rn")).cast("bigint").alias(rank))
    added += [(F.col(f"_sum0_{n}") + F.coalesce(f"_s_{n}", F.lit(0))).alias(n) for n in sums]
    added += [F.coalesce(f"_lag_{n}", f"_lag0_{n}")["v"].alias(n) for n in lags]
    added += [F.coalesce(f"_lead_{n}", f"_lead0_{n}")["v"].alias(n) for n in leads]
    return rows.select(*out, *added)


def minute(ts: str) -> Column:
    """Chunks of a minute: what a key logs in one is bounded by its rate, however long or hot its log is."""
    return F.floor(F.unix_seconds(ts) / 60)


def block(number: str, size: int = 65536) -> Column:
    return F.floor(F.col(number) / size)


def top(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    """First k rows per key. Up to spark.sql.optimizer.windowGroupLimitThreshold map tasks drop what cannot be among them."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
