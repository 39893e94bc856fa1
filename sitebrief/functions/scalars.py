"""Dates, run times, costs, and the JSON of checkpoints and report sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions.urls import let

# Price in dollars of a million tokens read and written.
INPUT_PRICE = 3.0
OUTPUT_PRICE = 15.0


def lastmod(text: Column) -> Column:
    """A sitemap date: day, or day and time with or without zone (UTC assumed); else null."""
    t = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    shape = (
        r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
    )
    # A bare day followed by an offset-like tail is not a date; the shape test rejects it.
    return F.when(t.rlike(shape), t.try_cast("timestamp"))


def report_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("Unknown"))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def elapsed_seconds(now: Column, started: Column, paused_ms: Column) -> Column:
    ms = F.coalesce(paused_ms, F.lit(0))
    whole = _seconds(now, started).cast("bigint") - F.floor(ms / 1000)
    return F.coalesce(F.greatest(F.lit(0), whole), F.lit(0)).cast("bigint")


def eta_seconds(elapsed: Column, crawled: Column, total: Column) -> Column:
    ok = (crawled > 0) & (total > crawled)
    return F.when(ok, (elapsed / crawled * (total - crawled)).cast("bigint"))


def time_left(now: Column, started: Column, paused_ms: Column, timeout: int = 3600) -> Column:
    left = F.lit(float(timeout)) - (_seconds(now, started) - paused_ms / 1000)
    return F.when(started.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), left.cast("bigint"))).cast("bigint")


def input_cost(n: Column) -> Column:
    return n * F.lit(INPUT_PRICE) / F.lit(1_000_000)


def output_cost(n: Column) -> Column:
    return n * F.lit(OUTPUT_PRICE) / F.lit(1_000_000)


def total_cost(n_in: Column, n_out: Column) -> Column:
    return input_cost(n_in) + output_cost(n_out)


def remaining_cost(sections_left: Column, avg_tokens: int = 2000) -> Column:
    n = sections_left * F.lit(avg_tokens)
    return total_cost((n * F.lit(0.6)).cast("bigint"), (n * F.lit(0.4)).cast("bigint"))


def report_cost(n_in: Column, n_out: Column) -> Column:
    # Rounded as a number of 1e-4, not by its shortest decimal text: 0.02175 lies below the tie.
    return F.round((n_in * F.lit(0.000003) + n_out * F.lit(0.000015)) * F.lit(1e4)) / F.lit(1e4)


# Checkpoint fields in their stored spelling.
_LISTS = [("visited", "pagesVisited"), ("queued", "pagesQueued"), ("external", "externalLinksFound"),
          ("sections", "analysisSectionsCompleted")]
_COUNTS = [("depth", "currentDepth"), ("entities", "entitiesExtractedCount")]
_TIMES = [("started", "crawlStartTime"), ("saved", "lastCheckpointTime")]


def checkpoint(json: Column) -> Column:
    """A complete checkpoint struct from stored JSON: wrong or missing fields get defaults."""
    def build(v):
        none = F.array().cast("array<string>")
        lists = [F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), none).alias(n) for n, k in _LISTS]
        counts = [F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0).cast("bigint")).alias(n)
                  for n, k in _COUNTS]
        times = [F.try_variant_get(v, f"$.{k}", "string").alias(n) for n, k in _TIMES]
        version = F.coalesce(F.try_variant_get(v, "$.version", "bigint"), F.lit(1).cast("bigint")).alias("version")
        return F.struct(version, *lists, *counts, *times)

    return let(F.try_parse_json(json), build)


def section(v: Column, key: str) -> Column:
    """struct<content, sources, confidence> of one section of parsed JSON; plain text becomes content."""
    whole = F.try_variant_get(v, f"$.{key}", "variant")
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT<"), F.lit(False))
    text = F.try_variant_get(v, f"$.{key}", "string")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(is_object, F.coalesce(F.try_variant_get(v, f"$.{key}.content", "string"), F.lit("")))
        .otherwise(F.coalesce(text, F.lit(""))).alias("content"),
        F.when(is_object, F.coalesce(F.try_variant_get(v, f"$.{key}.sources", "array<string>"), none))
        .otherwise(none).alias("sources"),
        F.when(is_object, F.coalesce(F.try_variant_get(v, f"$.{key}.confidence", "double"), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("confidence"),
    )


def sections(json: Column) -> Column:
    """All export sections as array<struct<section, content, sources, confidence>>, in order."""
    return let(F.try_parse_json(json), lambda v: F.array(*[
        F.struct(F.lit(k).alias("section"), section(v, k).alias("s")) for k in P.EXPORT_SECTIONS]))


def merge_config(base: Column, override: Column) -> Column:
    """Union of two maps; for a key in both, the second wins even with a null."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, none), F.coalesce(override, none)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))
