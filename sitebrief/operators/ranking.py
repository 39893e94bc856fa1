"""Newest versions and sessions, frontiers, budgets, schedules, run-log windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.functions import scalars as S
from sitebrief.functions import urls as U
from sitebrief.operators.chunks import block, minute, running, top
from sitebrief.operators.joins import latest
from sitebrief.session import cut_lineage

# Allowed steps from phase to phase; page types that lead a source list.
NEXT_PHASES = {
    "queued": ["crawling"], "crawling": ["extracting", "completed"], "extracting": ["analyzing"],
    "analyzing": ["generating"], "generating": ["completed"], "completed": [],
}
KEY_PAGE_TYPES = ["about", "team", "product", "service", "contact"]


def version_at(analyses: DataFrame, wanted: DataFrame) -> DataFrame:
    """The named version per company (wanted: company_id, wanted_version), or the newest where none is named."""
    newest = analyses.groupBy("company_id").agg(F.max("version").alias("_newest"))
    target = newest.join(wanted, "company_id", "left").select(
        "company_id", F.coalesce("wanted_version", "_newest").alias("version"))
    return analyses.join(target, ["company_id", "version"])


def version_number(analyses: DataFrame) -> DataFrame:
    return running(analyses, ["company_id"], ["version"], block("version"), rank="version_number")


def retention(analyses: DataFrame, keep: int = 3) -> DataFrame:
    return top(analyses, ["company_id"], [F.desc("version")], keep)


def key_pages(pages: DataFrame, limit: int) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in KEY_PAGE_TYPES]), F.col("page_type"))
    rank = F.when(rank > 0, rank).otherwise(100)
    return top(pages.withColumn("_rank", rank), ["company_id"], [F.col("_rank"), F.col("page_id")], limit).drop("_rank")


def key_executives(entities: DataFrame, limit: int) -> DataFrame:
    people = entities.filter((F.col("entity_type") == "person") & (F.coalesce("role", F.lit("")) != ""))
    return top(people, ["company_id"], [F.col("entity_id")], limit)


def frontier_topk(frontier: DataFrame, k: int) -> DataFrame:
    """Next k unvisited URLs per site: by priority, depth, then order of discovery."""
    return top(frontier.filter(~F.col("visited")), ["site"],
               [F.col("priority"), F.col("depth"), F.col("ord"), F.col("url")], k)


def crawl_budget(log: DataFrame, max_pages: int, max_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Pages of each job inside both budgets, and the reason each job stopped.

    A page counts if fewer than max_pages came before it and less than max_seconds had passed
    when it started; the page limit is tested first, as it is before each fetch.
    """
    start = log.groupBy("job_id").agg(F.min("ts").alias("_t0"), F.count("*").alias("_n"))
    first = top(log, ["job_id"], [F.col("ts"), F.col("event_id")], max_pages + 1, "rn").join(start, "job_id")
    late = F.unix_micros("ts") - F.unix_micros("_t0") >= F.lit(max_seconds * 1_000_000)
    inside = first.filter((F.col("rn") <= max_pages) & ~late).drop("_t0", "_n")
    stop = first.groupBy("job_id").agg(F.count_if((F.col("rn") <= max_pages) & ~late).alias("pages"),
                                       F.first("_n").alias("_n"))
    reason = (
        F.when(F.col("pages") >= max_pages, "max_pages").when(F.col("pages") < F.col("_n"), "max_time")
        .otherwise("completed")
    )
    return inside, stop.select("job_id", "pages", reason.alias("reason"))


def exact_duplicates(pages: DataFrame) -> DataFrame:
    """Marks all but the first page of each (site, hash); returns page_id, site, hash, error.

    Texts are hashed once: the narrow rows are cut from what made them. The first page is a combining aggregate; only texts that occur twice or more are joined
    back, and a text with very many copies is split by the skew handling of the join.
    """
    pages = cut_lineage(pages.select("page_id", "site", "hash"))
    firsts = pages.groupBy("site", "hash").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    copied = firsts.filter("_n > 1").drop("_n")
    j = pages.join(copied, ["site", "hash"], "left")
    dup = F.coalesce(F.col("page_id") > F.col("_first"), F.lit(False))
    return j.withColumn("error", F.when(dup, "Duplicate content")).drop("_first")


def upload_row_check(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Accepts or rejects upload rows, with the message of the first failed test.

    A row repeats an earlier one only if that one was accepted; the first valid row of a URL is
    the one accepted, so its position (a combining aggregate) decides for all others.
    """
    name, url = U.strip(F.coalesce("company_name", F.lit(""))), U.strip(F.coalesce("website_url", F.lit("")))
    rows = rows.withColumn("_name", name).withColumn("_url", url)
    rows = rows.withColumn("_key", U.registry_key(U.with_scheme(F.col("_url"))))
    known = registry.select(U.registry_key(F.col("website_url")).alias("_key")).distinct().withColumn(
        "_known", F.lit(True))
    rows = rows.join(known, "_key", "left")
    # The messages of the failed tests.
    error = (
        F.when(F.col("_name") == "", "Company name is required")
        .when(F.length("_name") > 200, "Company name exceeds 200 characters")
        .when(U.upload_error(F.col("_url")).isNotNull(), U.upload_error(F.col("_url")))
        .when(F.col("_known"), F.concat(F.lit("Company with URL "), "_key", F.lit(" already exists")))
        .when(F.length(U.strip(F.coalesce("industry", F.lit("")))) > 100, "Industry exceeds 100 characters")
    )
    rows = rows.withColumn("_error", error)
    first = rows.filter(F.col("_error").isNull()).groupBy("_key").agg(F.min("row_no").alias("_first"))
    j = rows.join(first, "_key", "left")
    repeated = (F.col("_url") != "") & (F.col("_first") < F.col("row_no"))
    out = j.withColumn("error", F.when(repeated, "Duplicate URL in batch").otherwise(F.col("_error")))
    shown = F.when(F.col("_name") == "", F.concat(F.lit("Row "), "row_no")).otherwise(F.col("_name"))
    return out.select("row_no", shown.alias("company_name"), F.col("error").isNull().alias("accepted"), "error",
                      F.col("_key").alias("website_url"), "industry")


def fair_share(companies: DataFrame, batches: DataFrame, global_max: int = 10, batch_id: str | None = None) -> DataFrame:
    """Companies to start next: rounds over the active batches by priority and age, oldest member first.

    Per batch at most its free slots are ranked (map tasks drop the rest), so the final ranking
    sees at most slots x batches rows, and of those only the first ``global_max``.
    """
    active = batches.filter(F.col("status") == "processing")
    if batch_id is not None:
        active = active.filter(F.col("batch_id") == batch_id)
    busy = companies.filter("status = 'in_progress'")
    per_batch = busy.groupBy("batch_id").agg(F.count("*").alias("_busy"))
    slots = active.join(per_batch, "batch_id", "left").select(
        "batch_id", "priority", F.col("created_at").alias("batch_created"),
        (F.col("max_concurrent") - F.coalesce("_busy", F.lit(0))).alias("slots"))
    waiting = companies.filter("status = 'pending'").join(slots.filter("slots > 0"), "batch_id")
    # No batch can use more than the global number of slots.
    ranked = top(waiting, ["batch_id"], [F.col("created_at"), F.col("company_id")], global_max, "rn")
    ranked = ranked.filter(F.col("rn") <= F.col("slots"))
    chosen = ranked.orderBy("rn", "priority", "batch_created", "batch_id").limit(global_max)
    free = busy.agg((F.lit(global_max) - F.count("*")).alias("free"))
    return _first_n(chosen, free)


def _first_n(chosen: DataFrame, free: DataFrame) -> DataFrame:
    """Number the few chosen rows and keep as many as there are free slots (one row)."""
    order = W.partitionBy(F.lit(0)).orderBy("rn", "priority", "batch_created", "batch_id")
    numbered = chosen.withColumn("pick", F.row_number().over(order).cast("bigint")).withColumn("_one", F.lit(1))
    one = free.withColumn("_one", F.lit(1))
    return numbered.join(one, "_one").filter(F.col("pick") <= F.col("free")).drop("_one", "free")


def phase_transitions(log: DataFrame) -> DataFrame:
    """Steps of each job that are not allowed."""
    df = running(log, ["job_id"], ["ts", "event_id"], minute("ts"), lags={"previous": F.col("phase")})
    allowed = [f"{a}>{b}" for a, bs in NEXT_PHASES.items() for b in bs]
    step = F.concat("previous", F.lit(">"), "phase")
    return df.filter(F.col("previous").isNotNull() & ~step.isin(*allowed))


def pause_durations(log: DataFrame) -> DataFrame:
    """Milliseconds between each pause and the next resume, summed per job.

    A pause while paused and a resume while running change nothing.
    """
    df = log.filter(F.col("control").isNotNull()).select("job_id", "ts", "event_id", "control")
    df = running(df, ["job_id"], ["ts", "event_id"], minute("ts"), lags={"_before": F.col("control")})
    turns = df.filter(~F.col("control").eqNullSafe(F.col("_before"))).drop("_before")
    turns = running(turns, ["job_id"], ["ts", "event_id"], minute("ts"), leads={"_until": F.col("ts")})
    ms = F.floor((F.unix_micros("_until") - F.unix_micros("ts")) / 1000)
    return turns.filter("control = 'pause'").groupBy("job_id").agg(
        F.coalesce(F.sum(ms), F.lit(0)).cast("bigint").alias("paused_ms"))


def fetch_schedule(urls: DataFrame) -> DataFrame:
    """Earliest fetch second per URL: its rank in the domain times the delay (page_id is the order)."""
    df = running(urls, ["domain"], ["page_id"], block("page_id"), rank="rn")
    return df.withColumn("fetch_at", (F.col("rn") - 1) * F.col("effective_delay"))


def fetch_gaps(log: DataFrame, min_seconds: float) -> DataFrame:
    """Fetches that came sooner after the one before than the delay allows."""
    df = running(log, ["job_id"], ["ts", "event_id"], minute("ts"), lags={"_prev": F.col("ts")})
    gap = (F.unix_micros("ts") - F.unix_micros("_prev")) / 1e6
    return df.withColumn("gap", gap).filter(F.col("gap") < min_seconds).drop("_prev")


def resume_phase(sessions: DataFrame) -> DataFrame:
    """Where a job goes on, from the checkpoint of its newest session; no row without a checkpoint."""
    last = latest(sessions, "company_id", ["created_at", "session_id"], ["session_id", "checkpoint"])
    # An empty object counts as no checkpoint.
    stored = last.filter(F.col("checkpoint").isNotNull() & ~F.trim("checkpoint").isin("{}", "[]"))
    c = stored.select("company_id", "session_id", S.checkpoint(F.col("checkpoint")).alias("c"))
    some = lambda n: F.size(f"c.{n}") > 0
    phase = (
        F.when(some("sections") | (F.col("c.entities") > 0), "analyzing").when(some("visited"), "extracting")
        .when(some("queued"), "crawling").otherwise("queued")
    )
    restart = F.when(phase == "crawling", "queued").otherwise(phase)
    can = some("sections") | (F.col("c.entities") != 0) | some("visited") | some("queued")
    return c.select("company_id", "session_id", phase.alias("phase"), restart.alias("restart_phase"),
                    can.alias("can_resume"))
