"""Differences between two stored versions of a company's report, section by section.

Sections are nested values in JSON. They are taken apart as VARIANT, whose objects have sorted keys, so that a new order of
keys is no change; each level is one explode and one aggregate on the key that both versions fall on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_pairs(analyses: DataFrame) -> DataFrame:
    """Newest and second newest version per company, by two combining aggregates."""
    top = analyses.groupBy("company_id").agg(F.max("version").alias("current"))
    older = analyses.join(top, "company_id").filter(F.col("version") < F.col("current"))
    return older.groupBy("company_id").agg(F.max("version").alias("previous"), F.first("current").alias("current"))


def _exploded(df: DataFrame, text: str) -> DataFrame:
    """One row per member of an object or array in JSON: key (null in arrays), value as JSON."""
    return df.sparkSession.sql(
        f"SELECT d.*, e.key AS key, to_json(e.value) AS value FROM {{d}} d, LATERAL variant_explode(try_parse_json(d.{text})) AS e", d=df)


def _both(df: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    return df.groupBy(*keys).agg(at(0).alias("previous_value"), at(1).alias("current_value"))


def _change(previous: Column, current: Column) -> Column:
    return F.when(previous, "added").when(current, "removed").otherwise("modified")


def section_changes(pairs: DataFrame, analyses: DataFrame) -> DataFrame:
    """company_id, section, kind, field, previous_value, current_value, change_type (values as JSON).

    ``object``: keys of sections that are objects in both versions; a key with null counts as absent. ``array``: items that
    only one version has; order and repetition are no change. ``value``: any other difference, as a whole. A section that
    one version lacks counts as an empty object or array beside one. ``summary``: the executive summary, 100 characters.
    Text that is not JSON has no sections.
    """
    roles = pairs.select("company_id", F.explode(F.array(
        F.struct(F.col("previous").alias("version"), F.lit(0).alias("side")),
        F.struct(F.col("current").alias("version"), F.lit(1).alias("side")))).alias("r")).select("company_id", "r.*")
    both = analyses.join(roles, ["company_id", "version"]).select("company_id", "side", "full_analysis", "executive_summary")
    is_object = both.filter("full_analysis LIKE '%{%'").select("company_id", "side", "full_analysis")
    sections = _exploded(is_object, "full_analysis").filter("key IS NOT NULL").select(
        "company_id", "side", F.col("key").alias("section"), F.nullif("value", F.lit("null")).alias("value"))
    sections = _both(sections, ["company_id", "section"])
    kind_of = lambda c: F.when(F.col(c).startswith("{"), "object").when(F.col(c).startswith("["), "array").when(F.col(c).isNotNull(), "value")
    k0, k1 = kind_of("previous_value"), kind_of("current_value")
    kind = F.when(k0.isNull(), k1).when(k1.isNull() | (k0 == k1), k0).otherwise("value")
    sections = sections.filter("NOT previous_value <=> current_value").withColumn("kind", kind)

    inner = sections.filter("kind <> 'value'").select("company_id", "section", "kind", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("previous_value").alias("whole")),
        F.struct(F.lit(1).alias("side"), F.col("current_value").alias("whole")))).alias("x")).select("company_id", "section", "kind", "x.*")
    inner = _exploded(inner, "whole").select(
        "company_id", "section", "kind", "side", F.coalesce("key", "value").alias("field"),
        F.when(F.col("kind") == "object", F.nullif("value", F.lit("null"))).otherwise(F.col("value")).alias("value"))
    parts = _both(inner, ["company_id", "section", "kind", "field"]).filter("NOT previous_value <=> current_value")
    parts = parts.withColumn("change_type", _change(F.col("previous_value").isNull(), F.col("current_value").isNull()))

    none = lambda c: F.col(c).isNull() | (F.col(c) == "[]")
    whole = sections.filter("kind = 'value'").withColumn("field", F.col("section")).withColumn(
        "change_type", _change(none("previous_value"), none("current_value")))

    summary = both.select("company_id", "side", F.col("executive_summary").alias("value"))
    summary = _both(summary, ["company_id"]).filter("NOT previous_value <=> current_value")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    cut = lambda c: F.when(~blank(c), F.substring(c, 1, 100)).alias(c)
    kind = F.when(blank("previous_value") & ~blank("current_value"), "added").when(
        ~blank("previous_value") & ~blank("current_value"), "modified").when(blank("current_value"), "removed")
    summary = summary.select("company_id", F.lit("executiveSummary").alias("section"), F.lit("summary").alias("kind"),
                             F.lit("executiveSummary").alias("field"), kind.alias("change_type"), cut("previous_value"), cut("current_value"))
    return parts.unionByName(whole.select(parts.columns)).unionByName(summary.select(parts.columns))
