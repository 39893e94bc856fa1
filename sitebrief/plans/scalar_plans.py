"""Date, money and JSON scalars."""

from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions import scalars as S
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.registry import query

NOW = "2024-03-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("lastmod_parse", """WITH a AS (SELECT entry_id, lastmod,
  regexp_extract(lastmod, '^(\\d{4}-\\d{2}-\\d{2})(?:[T ](\\d{2}:\\d{2}:\\d{2})(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?$',
    ['d', 't', 'f', 'z']) AS p FROM v_lastmods),
b AS (SELECT entry_id, lastmod, try_cast(p.d || ' ' || CASE WHEN p.t = '' THEN '00:00:00' ELSE p.t END || p.f
    AS TIMESTAMP) AS local, CASE WHEN p.z IN ('', 'Z') THEN 0 ELSE
    (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (60 * p.z[2:3]::INT + replace(p.z, ':', '')[4:5]::INT) END AS off FROM a)
SELECT entry_id, lastmod, strftime(local - to_minutes(off), '%Y-%m-%d %H:%M:%S') AS parsed FROM b""")
def lastmod_parse(t):
    ts = S.lastmod(F.col("lastmod"))
    return t.v_lastmods.select("entry_id", "lastmod", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("report_date", "SELECT company_id, coalesce(strftime(started_at, '%Y-%m-%d %H:%M UTC'), 'Unknown') AS "
       "report_date FROM v_companies")
def report_date(t):
    return t.v_companies.select("company_id", S.report_date(F.col("started_at")).alias("report_date"))


elapsed_sql = (f"coalesce(greatest(0, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(started_at)::BIGINT "
               "- paused_ms // 1000), 0)")


@query("elapsed_seconds", f"SELECT company_id, {elapsed_sql} AS elapsed FROM v_companies")
def elapsed_seconds(t):
    return t.v_companies.select(
        "company_id", S.elapsed_seconds(now(), F.col("started_at"), F.col("paused_ms")).alias("elapsed"))


@query("eta_seconds", f"""WITH s AS (SELECT company_id, sum(pages_crawled)::BIGINT AS crawled,
  sum(pages_crawled + pages_queued)::BIGINT AS total FROM v_sessions GROUP BY company_id),
j AS (SELECT company_id, {elapsed_sql} AS elapsed, coalesce(crawled, 0) AS crawled, coalesce(total, 0) AS total
  FROM v_companies LEFT JOIN s USING (company_id))
SELECT company_id, CASE WHEN crawled > 0 AND total > crawled
  THEN CAST(floor(elapsed::DOUBLE / crawled * (total - crawled)) AS BIGINT) END AS eta FROM j""")
def eta_seconds(t):
    s = t.v_sessions.groupBy("company_id").agg(
        F.sum("pages_crawled").alias("crawled"), F.sum(F.col("pages_crawled") + F.col("pages_queued")).alias("total"))
    df = t.v_companies.join(s, "company_id", "left").fillna(0, ["crawled", "total"])
    elapsed = S.elapsed_seconds(now(), F.col("started_at"), F.col("paused_ms"))
    return df.select("company_id", S.eta_seconds(elapsed, F.col("crawled"), F.col("total")).alias("eta"))


_left = (f"CASE WHEN started_at IS NULL THEN -1 ELSE greatest(0, CAST(trunc(5000000 - (epoch(TIMESTAMP '{NOW}') - "
         "epoch(started_at) - paused_ms / 1000)) AS BIGINT)) END")


@query("time_left", f"SELECT company_id, {_left} AS time_left, {_left} = 0 AS timed_out FROM v_companies")
def time_left(t):
    left = S.time_left(now(), F.col("started_at"), F.col("paused_ms"), timeout=5_000_000)
    return t.v_companies.select("company_id", left.alias("time_left"), (left == 0).alias("timed_out"))


_in, _out = "input_tokens * 3.0::DOUBLE / 1000000", "output_tokens * 15.0::DOUBLE / 1000000"


@query("call_cost", f"SELECT usage_id, round({_in}, 6) AS input_cost, round({_out}, 6) AS output_cost, "
       f"round({_in} + {_out}, 6) AS total_cost FROM v_usages")
def call_cost(t):
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return t.v_usages.select("usage_id", F.round(S.input_cost(i), 6).alias("input_cost"), F.round(
        S.output_cost(o), 6).alias("output_cost"), F.round(S.total_cost(i, o), 6).alias("total_cost"))


@query("remaining_cost", """SELECT span_id, round(floor(span_id % 9 * 2000 * 0.6) * 3.0 / 1000000 +
  floor(span_id % 9 * 2000 * 0.4) * 15.0 / 1000000, 6)::DOUBLE AS remaining_cost FROM v_spans""")
def remaining_cost(t):
    return t.v_spans.select("span_id", F.round(S.remaining_cost(F.col("span_id") % 9), 6).alias("remaining_cost"))


@query("report_cost", """SELECT company_id, round(sum(input_tokens)::DOUBLE * 0.000003::DOUBLE +
  sum(output_tokens)::DOUBLE * 0.000015::DOUBLE, 4) AS report_cost FROM v_usages GROUP BY company_id""")
def report_cost(t):
    df = t.v_usages.groupBy("company_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return df.select("company_id", S.report_cost(F.col("i"), F.col("o")).alias("report_cost"))


def _list_sql(key):
    return (f"CASE WHEN json_valid(checkpoint) AND json_type(checkpoint, '$.{key}') = 'ARRAY' "
            f"THEN CAST(json_extract(checkpoint, '$.{key}') AS VARCHAR[]) ELSE [] END")


def _int_sql(key):
    return (f"CASE WHEN json_valid(checkpoint) THEN coalesce(CAST(trunc(try_cast(json_extract_string(checkpoint, "
            f"'$.{key}') AS DOUBLE)) AS BIGINT), 0) ELSE 0 END")


def _text_sql(key):
    return f"CASE WHEN json_valid(checkpoint) THEN json_extract_string(checkpoint, '$.{key}') END"


repaired_sql = f"""repaired AS (SELECT session_id, company_id, created_at, checkpoint, {_list_sql('pagesVisited')} AS visited,
  {_list_sql('pagesQueued')} AS queued, {_list_sql('externalLinksFound')} AS external,
  {_list_sql('analysisSectionsCompleted')} AS sections, {_int_sql('currentDepth')} AS depth,
  {_int_sql('entitiesExtractedCount')} AS entities, {_text_sql('crawlStartTime')} AS started,
  {_text_sql('lastCheckpointTime')} AS saved FROM v_sessions)"""


@query("checkpoint_repair", f"""WITH {repaired_sql} SELECT session_id, array_to_string(visited, ' ') AS visited,
  array_to_string(queued, ' ') AS queued, array_to_string(external, ' ') AS external,
  array_to_string(sections, ' ') AS sections, depth, entities, started, saved, 1::BIGINT AS version FROM repaired""")
def checkpoint_repair(t):
    c = t.v_sessions.select("session_id", S.checkpoint(F.col("checkpoint")).alias("c")).select("session_id", "c.*")
    for n in ("visited", "queued", "external", "sections"):
        c = c.withColumn(n, F.array_join(n, " "))
    return c


@query("checkpoint_stats", f"""WITH {repaired_sql} SELECT session_id, CAST(len(visited) AS BIGINT) AS visited,
  CAST(len(queued) AS BIGINT) AS queued, CAST(len(external) AS BIGINT) AS external, depth, entities,
  CAST(len(sections) AS BIGINT) AS sections, saved FROM repaired""")
def checkpoint_stats(t):
    c = t.v_sessions.select("session_id", S.checkpoint(F.col("checkpoint")).alias("c"))
    sizes = [F.size(f"c.{n}").cast("bigint").alias(n) for n in ("visited", "queued", "external", "sections")]
    return c.select("session_id", *sizes, "c.depth", "c.entities", "c.saved")


_keys = ", ".join(f"('{k}')" for k in P.EXPORT_SECTIONS)
sections_sql = f"""secs AS (SELECT analysis_id, k AS section, json_type(full_analysis, '$.' || k) AS ty,
  json_extract_string(full_analysis, '$.' || k) AS txt, json_extract_string(full_analysis, '$.' || k || '.content') AS co,
  CASE WHEN json_type(full_analysis, '$.' || k || '.sources') = 'ARRAY'
    THEN array_to_string(CAST(json_extract(full_analysis, '$.' || k || '.sources') AS VARCHAR[]), ' ') ELSE '' END AS so,
  try_cast(json_extract_string(full_analysis, '$.' || k || '.confidence') AS DOUBLE) AS cf
  FROM v_analyses, (VALUES {_keys}) ks(k)),
sections AS (SELECT analysis_id, section, CASE WHEN ty = 'OBJECT' THEN coalesce(co, '') ELSE coalesce(txt, '') END
  AS content, CASE WHEN ty = 'OBJECT' THEN so ELSE '' END AS sources,
  CASE WHEN ty = 'OBJECT' THEN coalesce(cf, 0.0) ELSE 0.0 END::DOUBLE AS confidence FROM secs)"""


@query("sections_normalize", f"WITH {sections_sql} SELECT * FROM sections")
def sections_normalize(t):
    df = t.v_analyses.select("analysis_id", F.inline(S.sections(F.col("full_analysis"))))
    return df.select("analysis_id", "section", "s.content", F.array_join("s.sources", " ").alias("sources"),
                     "s.confidence")


@query("checkpoint_to_frontier", f"""WITH {repaired_sql},
q AS (SELECT session_id, unnest(queued) AS url, generate_subscripts(queued, 1) - 1 AS ord FROM repaired),
v AS (SELECT session_id, unnest(visited) AS url FROM repaired)
SELECT session_id, url, 'queued' AS state, CAST(ord AS BIGINT) AS ord, CAST(0 AS BIGINT) AS depth, 'other' AS page_type,
  CAST(10 AS BIGINT) AS priority FROM q
UNION ALL SELECT session_id, url, 'visited', NULL, NULL, NULL, NULL FROM v""")
def checkpoint_to_frontier(t):
    from sitebrief.operators.frontier import from_checkpoints

    return from_checkpoints(t.v_sessions.select("session_id", S.checkpoint(F.col("checkpoint")).alias("c")))


@query("config_merge", """SELECT company_id, 'maxPages' AS key, CASE WHEN seq % 2 = 0 THEN '50' ELSE '100' END AS value
  FROM v_companies UNION ALL SELECT company_id, 'maxDepth', CAST(seq % 5 AS VARCHAR) FROM v_companies
UNION ALL SELECT company_id, 'followLinkedIn', NULL FROM v_companies WHERE seq % 2 = 0""")
def config_merge(t):
    base = F.create_map(F.lit("maxPages"), F.lit("100"), F.lit("maxDepth"), (F.col("seq") % 5).cast("string"))
    over = F.when(F.col("seq") % 2 == 0, F.create_map(
        F.lit("maxPages"), F.lit("50"), F.lit("followLinkedIn"), F.lit(None).cast("string")))
    return t.v_companies.select("company_id", F.explode(S.merge_config(base, over)))
