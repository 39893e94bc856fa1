"""Mixing sources to target weights by weighted sampling without replacement.

Each document gets an exponential key divided by its quality weight (Efraimidis and Spirakis), drawn from a digest of
its id, so that runs agree. Within a source documents stand in the order of their keys. A source's target is met by as
many complete epochs as fit; the rest is taken from the front of the order, up to the document whose middle passes the
budget. The choice is one cut-off key per source; no text is moved.

The prefix sums of a source run in chunks of its keys, so that a source with a third of all documents is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.llm.common import SPACE, written
from sitebrief.llm.quality import BLANKS, SYMBOLS
from sitebrief.operators.chunks import running

WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Number of words; 0 for a null or empty text."""
    pieces = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""))
    return pieces.cast("bigint")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less with each sign among its characters, 0.1 at least."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(text, BLANKS, ""))
    signs = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - signs * 2.0 / F.greatest(chars, F.lit(1)))


def sampling_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Exponential variable over the weight. It depends on id, text and seed alone; a null id counts as the word null."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") + 0.5) / float(2**52)
    return -F.log(uniform) / quality_weight(text)


def _narrow(documents: DataFrame, seed: str) -> DataFrame:
    return documents.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                            sampling_key(F.col("doc_id"), F.col("text"), seed).alias("key"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: rank, source_size, target. Weights repeat over the sources by code point, null last.

    Sources are filled in the order in which they would reach ``most`` times their size; the first that does not reach
    it fixes the level for the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on; these windows run over sources, not documents.
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = by_source.withColumn("rank", rank.cast("bigint"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.col("source_size") * most / F.col("weight"))
    everything = W.orderBy("full", "rank")
    before = everything.rowsBetween(W.unboundedPreceding, -1)
    after = everything.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(whole) * share
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    level = ranked.withColumn("level", (total - spent) / F.sum("weight").over(after))
    first = F.min_by(F.when(F.col("full") >= F.col("level"), F.col("level")),
                     F.when(F.col("full") >= F.col("level"), F.struct("full", "rank"))).over(whole)
    target = F.least(F.col("source_size") * most, F.col("weight") * first)
    return level.select("source", "rank", "source_size", target.alias("target"))


def plan_mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0,
             seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): the narrow table of all documents, and a row per source with its target and cut-off."""
    sizes = written(_narrow(documents, seed), "mix-sizes")
    sources = written(targets(sizes, weights, share, most), "mix-sources")
    # Rows with equal ids are chosen together.
    units = (sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop("source")
             .groupBy("rank", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("source_size").alias("source_size"),
                                                   F.first("target").alias("target")))
    chunk = F.floor(F.log2("key") * 1024)  # a chunk holds less than a thousandth of a source
    summed = running(units, ["rank"], ["key", "doc_id"], chunk, sums={"upto": F.col("size")})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - epochs * F.col("source_size")
    fits = F.col("upto") - F.col("size") / 2 <= budget
    cuts = summed.groupBy("rank").agg(F.max(F.when(fits, F.struct("key", "doc_id"))).alias("cut"))
    cuts = sources.join(cuts, "rank", "left").withColumn("epochs", epochs.cast("bigint"))
    return sizes, written(cuts, "mix-cuts")


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = rows.join(cuts.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")))
    front = F.coalesce(F.struct("key", "doc_id") <= F.col("cut"), F.lit(False))
    return joined.withColumn("copies", F.col("epochs") + front.cast("bigint"))


def mix_table(documents: DataFrame, **options) -> DataFrame:
    """One row per row of ``documents``: its size, its source's size and target, and the words taken from it.

    A null source is a source of its own; an empty text has size 0 and takes nothing; an empty table gives no rows.
    """
    sizes, cuts = plan_mix(documents, **options)
    return _taken(sizes, cuts).select("doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(documents: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, columns as they were, clashing names included.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own; rows with equal keys go by
    id, and rows that are wholly equal are drawn alike; an empty table gives an empty one.
    """
    _, cuts = plan_mix(documents, seed=seed, **options)
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "doc_id", "source",
                            sampling_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return _taken(rows, cuts).filter("copies > 0").withColumn("_copy", copies).select("_row.*")
