"""Aggregations. All of them combine before their shuffle; ordered lists are bounded first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions import scalars as S
from sitebrief.operators.chunks import minute, running, top

# Kinds of model calls; any other counts as analysis.
CALL_TYPES = ["extraction", "summarization", "analysis"]


def call_type(c: Column) -> Column:
    return F.when(F.lower(c).isin(*CALL_TYPES), F.lower(c)).otherwise("analysis")


def entity_stats(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per company and type the count; per company totals, mean confidence, pages with entities."""
    by_type = entities.groupBy("company_id", "entity_type").agg(F.count("*").alias("n"))
    # Distinct sources in two steps, so a company with most rows is spread by its sources.
    per_source = entities.groupBy("company_id", "source_url").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("s"))
    total = per_source.groupBy("company_id").agg(
        F.sum("n").alias("total_entities"), F.round(F.sum("s") / F.sum("n"), 3).alias("average_confidence"),
        F.count("source_url").alias("pages_with_entities"))
    return by_type, total


def extract_summary(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per company: a count column per entity type, and pages processed."""
    wide = entities.groupBy("company_id").agg(
        *[F.count_if(F.col("entity_type") == e).alias(e) for e in P.ENTITY_TYPES])
    n = pages.groupBy("company_id").agg(F.count("*").alias("pages_processed"))
    return n.join(wide, "company_id", "full_outer").fillna(0)


def usage_rollup(usages: DataFrame) -> DataFrame:
    """Totals per company, per call type and per section, in one pass over the calls."""
    df = usages.withColumn("call_type", call_type(F.col("call_type"))).withColumn(
        "section", F.nullif("section", F.lit("")))
    sets = df.groupingSets(
        [[F.col("company_id")], [F.col("company_id"), F.col("call_type")], [F.col("company_id"), F.col("section")]],
        "company_id", "call_type", "section",
    ).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
          F.grouping("call_type").alias("_t"), F.grouping("section").alias("_s"))
    level = F.when(F.col("_t") == 0, "call_type").when(F.col("_s") == 0, "section").otherwise("total")
    out = sets.withColumn("level", level).filter((F.col("level") != "section") | F.col("section").isNotNull())
    cost = F.round(S.total_cost(F.col("input_tokens"), F.col("output_tokens")), 6)
    return out.withColumn("cost", cost).drop("_t", "_s")


def usage_running(usages: DataFrame) -> DataFrame:
    """Tokens and cost of the company after each call."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    df = running(usages, ["company_id"], ["ts", "usage_id"], minute("ts"),
                 sums={"running_input": F.col("input_tokens"), "running_output": F.col("output_tokens"),
                       "running_tokens": tokens})
    cost = F.round(S.total_cost(F.col("running_input"), F.col("running_output")), 6)
    return df.withColumn("call_type", call_type(F.col("call_type"))).withColumn("running_cost", cost)


def batch_counts(companies: DataFrame) -> DataFrame:
    s = F.col("status")
    return companies.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "in_progress").alias("processing"), F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "failed").alias("failed"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def with_batch_counts(batches: DataFrame, companies: DataFrame) -> DataFrame:
    """Batches with member counts, sums, derived status and progress; empty batches count zero."""
    n = ["total", "pending", "processing", "completed", "failed", "tokens"]
    df = batches.join(batch_counts(companies), "batch_id", "left").fillna(0, n).fillna(0.0, ["cost"])
    status = (
        F.when(F.col("status").isin("cancelled", "paused"), F.col("status"))
        .when((F.col("pending") == 0) & (F.col("processing") == 0), "completed")
        .when((F.col("processing") > 0) | (F.col("completed") > 0), "processing")
        .otherwise(F.col("status"))
    )
    done = F.round((F.col("completed") + F.col("failed")) / F.col("total") * 100, 2)
    return df.withColumn("new_status", status).withColumn(
        "progress", F.when(F.col("total") > 0, done).otherwise(0.0))


def queue_status(companies: DataFrame) -> DataFrame:
    """(kind, name, n): companies per status, in all, and per phase among those in progress."""
    per = companies.groupBy("status", "phase").agg(F.count("*").alias("n"))
    # per is at most statuses x phases rows; what follows is tiny.
    by_status = per.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.sum("n").alias("n"))
    total = per.groupBy(F.lit("total").alias("kind"), F.lit("total").alias("name")).agg(F.sum("n").alias("n"))
    phases = per.filter("status = 'in_progress'").select(F.lit("phase").alias("kind"), F.col("phase").alias("name"), "n")
    return by_status.unionByName(total).unionByName(phases)


def frontier_stats(frontier: DataFrame) -> DataFrame:
    v = F.col("visited")
    per_type = [F.count_if(~v & (F.col("page_type") == p)).alias(f"pending_{p}") for p in P.PAGE_TYPES]
    return frontier.groupBy("site").agg(
        F.count_if(~v).alias("pending"), F.count_if(v).alias("visited"), F.count("*").alias("seen"), *per_type)


def crawl_counters(log: DataFrame) -> DataFrame:
    """Crawled pages (failures too), errors, duplicates and external links per job."""
    bad = F.col("error").isNotNull() | ~F.col("status_code").between(200, 399)
    return log.groupBy("job_id").agg(
        F.count("*").alias("crawled"), F.count_if(bad).alias("errors"),
        F.count_if(F.col("error") == "Duplicate content").alias("duplicates"),
        F.sum("external_links").alias("external_links"))


def success(error: Column, content: Column) -> Column:
    return error.isNull() & (F.coalesce(content, F.lit("")) != "")


def analysis_success(results: DataFrame) -> DataFrame:
    ok = success(F.col("error"), F.col("content"))
    need = [F.coalesce(F.bool_or(F.when(F.col("section") == s, ok)), F.lit(False)) for s in P.REQUIRED_SECTIONS]
    return results.groupBy("analysis_id").agg((need[0] & need[1] & need[2]).alias("success"))


def analysis_totals(results: DataFrame) -> DataFrame:
    """Token sums, successful sections and the errors in section order (a report has few sections)."""
    ok = success(F.col("error"), F.col("content"))
    message = F.when(F.col("error").isNotNull(), F.struct("ord", F.concat("section", F.lit(": "), "error").alias("m")))
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]), "; ")
    return results.groupBy("analysis_id").agg(
        F.sum("input_tokens").alias("total_input"), F.sum("output_tokens").alias("total_output"),
        F.count_if(ok).alias("successful"), errors.alias("errors"))


def previous_sections_text(results: DataFrame, run_order: list[str]) -> DataFrame:
    """For the two last kinds of section: headed texts of the successful sections before them."""
    names = dict((s, n) for s, n, _ in P.SECTIONS)
    place = F.array_position(F.array(*[F.lit(s) for s in run_order]), F.col("section"))
    head = None
    for s, n in names.items():
        is_s = F.col("section") == s
        head = F.when(is_s, n) if head is None else head.when(is_s, n)
    text = F.concat(F.lit("=== "), head, F.lit(" ===\n"), "content")
    ok = success(F.col("error"), F.col("content"))
    done = results.withColumn("place", place).groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct("place", text.alias("text"))))).alias("done"),
        F.collect_set(F.when(F.col("section").isin("key_insights", "executive_summary"), F.struct("place", "section")))
        .alias("wanted"))
    rows = done.select("analysis_id", "done", F.inline("wanted"))
    before = F.transform(F.filter("done", lambda d: d["place"] < F.col("place")), lambda d: d["text"])
    return rows.select("analysis_id", "section", F.array_join(before, "\n\n").alias("previous_analysis"))


def version_tokens(analyses: DataFrame) -> DataFrame:
    breakdown = F.create_map(F.lit("total_input"), F.col("total_input"), F.lit("total_output"), F.col("total_output"))
    total = F.aggregate(F.map_values(breakdown), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return analyses.select("company_id", "version", total.alias("tokens_used"))


def ordered_text(df: DataFrame, keys: list[str], order: list[str], piece: Column, sep: str, limit: int | None) -> DataFrame:
    """Pieces of a key joined in order and cut at ``limit`` characters, if given (column joined).

    Without a limit a key's whole text becomes one value; ``context_rows`` is the form for keys of any size.

    A piece and its separator take at least one character, so no more than ``limit`` pieces can
    show in the result. Map tasks drop the others; then pieces that start behind the limit go.
    Only then are the rest collected, at most ``limit`` characters and one piece per key.
    """
    assert sep, "pieces need a separator, or their number has no bound"
    df = df.select(*keys, *order, piece.alias("_piece")).filter(F.col("_piece").isNotNull())
    if limit is None:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_piece"))), lambda x: x["_piece"])
        return df.groupBy(*keys).agg(F.array_join(parts, sep).alias("joined"))
    df = top(df, keys, [F.col(c) for c in order], limit, "_rn")
    w = W.partitionBy(*keys).orderBy("_rn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_piece") + len(sep)).over(w), F.lit(0))
    df = df.withColumn("_start", start).filter(F.col("_start") < limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_piece"))), lambda x: x["_piece"])
    return df.groupBy(*keys).agg(F.substring(F.array_join(parts, sep), 1, limit).alias("joined"))


def _entity_label() -> Column:
    return F.concat("entity_value", F.coalesce(F.concat(F.lit(" ("), "role", F.lit(")")), F.lit("")),
                    F.coalesce(F.concat(F.lit(" - "), "relationship"), F.lit("")))


def context_rows(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """The same texts uncut, as rows (company_id, kind, type, position, piece); nothing is collected."""
    texts = pages.filter(F.coalesce("text", F.lit("")) != "").select(
        "company_id", F.lit("page").alias("kind"), F.col("page_type").alias("type"), F.col("page_id").alias("position"),
        F.concat(F.lit("["), "url", F.lit("]\n"), "text", F.lit("\n")).alias("piece"))
    names = entities.select("company_id", F.lit("entity").alias("kind"), F.col("entity_type").alias("type"),
                            F.col("entity_id").alias("position"), _entity_label().alias("piece"))
    return texts.unionByName(names)


def context_assembly(pages: DataFrame, entities: DataFrame, page_chars: int | None = None, content_chars: int | None = None,
                     part_chars: int | None = None, list_chars: int | None = None) -> DataFrame:
    """The texts a report is written from, one row per company.

    The caller can limit the characters of a page, of the whole content, of a part of it (team, careers, entities) and
    of a list of entities; by default nothing is cut.

    pages: company_id, page_id, url, page_type, text; entities: company_id, entity_id,
    entity_type, entity_value, role, relationship. Types stand in order of their first page.
    """
    cut = lambda c, n: (F.col(c) if isinstance(c, str) else c) if n is None else F.substring(c, 1, n)
    piece = F.when(F.coalesce("text", F.lit("")) != "", F.concat(
        F.lit("["), "url", F.lit("]\n"), cut("text", page_chars), F.lit("\n")))
    types = pages.groupBy("company_id", "page_type").agg(F.min("page_id").alias("first_page"))
    texts = ordered_text(pages, ["company_id", "page_type"], ["page_id"], piece, "\n", content_chars)
    per_type = types.join(texts, ["company_id", "page_type"], "left")
    headed = F.concat(F.lit("=== "), F.upper("page_type"), F.lit(" PAGES ===\n"), F.coalesce("joined", F.lit("")))
    # At most ten page types and eleven entity types per company: small arrays.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first_page", headed.alias("t")))), lambda x: x["t"])
    of_type = lambda t, n: F.coalesce(cut(F.max(F.when(F.col("page_type") == t, F.col("joined"))), n), F.lit(""))
    content = per_type.groupBy("company_id").agg(
        cut(F.array_join(parts, "\n\n"), content_chars).alias("content"),
        of_type("team", part_chars).alias("team_content"), of_type("careers", part_chars).alias("careers_content"))

    label = _entity_label()
    firsts = entities.groupBy("company_id", "entity_type").agg(F.min("entity_id").alias("first_entity"))
    lists = ordered_text(entities, ["company_id", "entity_type"], ["entity_id"], label, ", ", part_chars)
    lines = ordered_text(entities.filter(F.col("entity_type").isin("person", "org", "tech_stack")),
                         ["company_id", "entity_type"], ["entity_id"], F.concat(F.lit("- "), label), "\n", list_chars)
    every = firsts.join(lists, ["company_id", "entity_type"])
    named = F.struct("first_entity", F.concat("entity_type", F.lit(": "), "joined").alias("t"))
    ents = every.groupBy("company_id").agg(cut(F.array_join(F.transform(
        F.array_sort(F.collect_list(named)), lambda x: x["t"]), "\n"), part_chars).alias("entities"))
    kind = lambda e: F.coalesce(F.max(F.when(F.col("entity_type") == e, F.col("joined"))), F.lit(""))
    people = lines.groupBy("company_id").agg(
        kind("person").alias("people_entities"), kind("org").alias("org_entities"),
        kind("tech_stack").alias("tech_entities"))
    out = content.join(ents, "company_id", "full_outer").join(people, "company_id", "full_outer")
    return out.fillna("")
