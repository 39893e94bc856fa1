"""Aggregation queries."""

from pyspark.sql import functions as F

from sitebrief.functions import classify as C
from sitebrief.functions import patterns as P
from sitebrief.operators import aggregates as A
from sitebrief.operators import ranking as K
from sitebrief.plans.extract_plans import SECTION_ORDER
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.page_plans import first_type_sql
from sitebrief.plans.rank_plans import upload_sql
from sitebrief.plans.registry import query


@query("entity_stats", """SELECT company_id, count(*) AS total_entities, round(avg(confidence), 3) AS average_confidence,
  count(DISTINCT source_url) AS pages_with_entities FROM v_entities GROUP BY company_id""")
def entity_stats(t):
    return A.entity_stats(t.v_entities)[1]


@query("entity_stats_by_type", "SELECT company_id, entity_type, count(*) AS n FROM v_entities GROUP BY 1, 2")
def entity_stats_by_type(t):
    return A.entity_stats(t.v_entities)[0]


_types = ", ".join(f"coalesce(e.{x}, 0) AS {x}" for x in P.ENTITY_TYPES)
_typed = ", ".join(f"count(*) FILTER (WHERE entity_type = '{x}') AS {x}" for x in P.ENTITY_TYPES)


@query("extract_summary", f"""WITH e AS (SELECT company_id, {_typed} FROM v_entities GROUP BY 1),
p AS (SELECT company_id, count(*) AS n FROM v_pages GROUP BY 1)
SELECT coalesce(p.company_id, e.company_id) AS company_id, coalesce(p.n, 0) AS pages_processed, {_types}
FROM p FULL OUTER JOIN e ON e.company_id = p.company_id""")
def extract_summary(t):
    return A.extract_summary(t.v_entities, t.v_pages)


_calls = """uc AS (SELECT usage_id, company_id, CASE WHEN lower(call_type) IN ('extraction', 'summarization', 'analysis')
  THEN lower(call_type) ELSE 'analysis' END AS call_type, nullif(section, '') AS section, input_tokens, output_tokens, ts
  FROM v_usages)"""
_sum = "CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o"
_cost = "round(i * 3.0::DOUBLE / 1000000 + o * 15.0::DOUBLE / 1000000, 6)"


@query("usage_rollup", f"""WITH {_calls}, r AS (SELECT company_id, 'total' AS level, NULL AS name, {_sum} FROM uc GROUP BY 1
  UNION ALL SELECT company_id, 'call_type', call_type, {_sum} FROM uc GROUP BY 1, 3
  UNION ALL SELECT company_id, 'section', section, {_sum} FROM uc WHERE section IS NOT NULL GROUP BY 1, 3)
SELECT company_id, level, name, i AS input_tokens, o AS output_tokens, {_cost} AS cost FROM r""")
def usage_rollup(t):
    df = A.usage_rollup(t.v_usages)
    return df.select("company_id", "level", F.coalesce("call_type", "section").alias("name"), "input_tokens",
                     "output_tokens", "cost")


@query("usage_totals", f"""WITH s AS (SELECT company_id, {_sum} FROM v_usages GROUP BY 1)
SELECT company_id, i AS input_tokens, o AS output_tokens, i + o AS total_tokens FROM s""")
def usage_totals(t):
    return t.v_usages.groupBy("company_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query("usage_running", f"""WITH {_calls}, r AS (SELECT usage_id, company_id, call_type,
  CAST(sum(input_tokens) OVER w AS BIGINT) AS i, CAST(sum(output_tokens) OVER w AS BIGINT) AS o FROM uc
  WINDOW w AS (PARTITION BY company_id ORDER BY ts, usage_id ROWS UNBOUNDED PRECEDING))
SELECT usage_id, company_id, call_type, i + o AS running_tokens, {_cost} AS running_cost FROM r""")
def usage_running(t):
    return A.usage_running(t.v_usages).select("usage_id", "company_id", "call_type", "running_tokens", "running_cost")


_counts = """bc AS (SELECT b.batch_id, b.status, count(c.company_id) AS total,
  count(*) FILTER (WHERE c.status = 'pending') AS pending, count(*) FILTER (WHERE c.status = 'in_progress') AS processing,
  count(*) FILTER (WHERE c.status = 'completed') AS completed, count(*) FILTER (WHERE c.status = 'failed') AS failed,
  CAST(coalesce(sum(c.tokens), 0) AS BIGINT) AS tokens, coalesce(sum(c.cost), 0.0) AS cost
  FROM v_batches b LEFT JOIN v_companies c USING (batch_id) GROUP BY 1, 2)"""


def _batches(t):
    return A.with_batch_counts(t.v_batches, t.v_companies)


@query("batch_counts", f"WITH {_counts} SELECT batch_id, total, pending, processing, completed, failed FROM bc")
def batch_counts(t):
    return _batches(t).select("batch_id", "total", "pending", "processing", "completed", "failed")


@query("batch_status_derive", f"""WITH {_counts} SELECT batch_id, status, CASE WHEN status IN ('cancelled', 'paused') THEN
  status WHEN pending = 0 AND processing = 0 THEN 'completed' WHEN processing > 0 OR completed > 0 THEN 'processing'
  ELSE status END AS new_status FROM bc""")
def batch_status_derive(t):
    return _batches(t).select("batch_id", "status", "new_status")


@query("batch_progress", f"""WITH {_counts} SELECT batch_id, CASE WHEN total > 0 THEN
  round((completed + failed) / total * 100, 2) ELSE 0.0 END::DOUBLE AS progress FROM bc""")
def batch_progress(t):
    return _batches(t).select("batch_id", "progress")


@query("batch_tokens", f"WITH {_counts} SELECT batch_id, tokens, round(cost, 4) AS cost FROM bc")
def batch_tokens(t):
    return _batches(t).select("batch_id", "tokens", F.round("cost", 4).alias("cost"))


@query("queue_status", """SELECT 'status' AS kind, status AS name, count(*) AS n FROM v_companies GROUP BY 2
UNION ALL SELECT 'total', 'total', count(*) FROM v_companies
UNION ALL SELECT 'phase', phase, count(*) FROM v_companies WHERE status = 'in_progress' GROUP BY 2""")
def queue_status(t):
    return A.queue_status(t.v_companies)


_pend = ", ".join(f"count(*) FILTER (WHERE NOT visited AND page_type = '{p}') AS pending_{p}" for p in P.PAGE_TYPES)


@query("frontier_stats", f"""SELECT site, count(*) FILTER (WHERE NOT visited) AS pending, count(*) FILTER (WHERE visited)
  AS visited, count(*) AS seen, {_pend} FROM v_frontier GROUP BY site""")
def frontier_stats(t):
    return A.frontier_stats(t.v_frontier)


@query("crawl_counters", """SELECT job_id, count(*) AS crawled, count(*) FILTER (WHERE error IS NOT NULL OR
  status_code NOT BETWEEN 200 AND 399) AS errors, count(*) FILTER (WHERE error = 'Duplicate content') AS duplicates,
  CAST(sum(external_links) AS BIGINT) AS external_links FROM v_events GROUP BY job_id""")
def crawl_counters(t):
    return A.crawl_counters(t.v_events)


@query("upload_summary", f"""WITH {upload_sql} SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful,
  count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM checked""")
def upload_summary(t):
    df = K.upload_row_check(t.v_uploads, t.v_companies)
    return df.agg(F.count("*").alias("total"), F.count_if("accepted").alias("successful"),
                  F.count_if(~F.col("accepted")).alias("failed"))


_ok = "error IS NULL AND coalesce(content, '') <> ''"
_need = ", ".join(O.lit(s) for s in P.REQUIRED_SECTIONS)


@query("analysis_success", f"""SELECT analysis_id, count(DISTINCT CASE WHEN section IN ({_need}) AND {_ok} THEN section END)
  = 3 AS success FROM v_section_results GROUP BY 1""")
def analysis_success(t):
    return A.analysis_success(t.v_section_results)


@query("analysis_totals", f"""SELECT analysis_id, CAST(sum(input_tokens) AS BIGINT) AS total_input,
  CAST(sum(output_tokens) AS BIGINT) AS total_output, count(*) FILTER (WHERE {_ok}) AS successful,
  coalesce(string_agg(section || ': ' || error, '; ' ORDER BY ord) FILTER (WHERE error IS NOT NULL), '') AS errors
FROM v_section_results GROUP BY 1""")
def analysis_totals(t):
    return A.analysis_totals(t.v_section_results)


_order = ", ".join(f"('{s}', {i + 1}, {O.lit(dict((a, b) for a, b, _ in P.SECTIONS)[s])})"
                   for i, s in enumerate(SECTION_ORDER))


@query("previous_sections_text", f"""WITH n(section, place, name) AS (VALUES {_order}),
r AS (SELECT * FROM v_section_results JOIN n USING (section))
SELECT a.analysis_id, a.section, coalesce(string_agg('=== ' || b.name || ' ===' || chr(10) || b.content,
  chr(10) || chr(10) ORDER BY b.place) FILTER (WHERE b.error IS NULL AND coalesce(b.content, '') <> ''), '')
  AS previous_analysis FROM r a LEFT JOIN r b ON a.analysis_id = b.analysis_id AND b.place < a.place
WHERE a.section IN ('key_insights', 'executive_summary') GROUP BY 1, 2""")
def previous_sections_text(t):
    return A.previous_sections_text(t.v_section_results, SECTION_ORDER)


@query("version_tokens", "SELECT company_id, version, total_input + total_output AS tokens_used FROM v_analyses")
def version_tokens(t):
    return A.version_tokens(t.v_analyses)


_label = ("entity_value || coalesce(' (' || role || ')', '') || coalesce(' - ' || relationship, '')")


context_sql = f"""WITH st AS (SELECT page_id, company_id, url, text, lower({O.path('url')}) AS p FROM v_site_texts),
pg AS (SELECT page_id, company_id, {first_type_sql} AS page_type, '[' || url || ']' || chr(10) || substr(text, 1, 5000) ||
  chr(10) AS piece FROM st),
ty AS (SELECT company_id, page_type, min(page_id) AS f, string_agg(piece, chr(10) ORDER BY page_id) AS j FROM pg GROUP BY 1, 2),
co AS (SELECT company_id, substr(string_agg('=== ' || upper(page_type) || ' PAGES ===' || chr(10) || j, chr(10) || chr(10)
  ORDER BY f), 1, 50000) AS content, coalesce(substr(max(j) FILTER (WHERE page_type = 'team'), 1, 10000), '') AS tc,
  coalesce(substr(max(j) FILTER (WHERE page_type = 'careers'), 1, 10000), '') AS cc FROM ty GROUP BY 1),
el AS (SELECT 'src' || substr(company_id, 2) AS company_id, entity_id, entity_type, {_label} AS label FROM v_entities),
et AS (SELECT company_id, entity_type, min(entity_id) AS f, substr(string_agg(label, ', ' ORDER BY entity_id), 1, 10000) AS j,
  substr(string_agg('- ' || label, chr(10) ORDER BY entity_id), 1, 5000) AS l FROM el GROUP BY 1, 2),
en AS (SELECT company_id, substr(string_agg(entity_type || ': ' || j, chr(10) ORDER BY f), 1, 10000) AS e,
  coalesce(max(l) FILTER (WHERE entity_type = 'person'), '') AS pe, coalesce(max(l) FILTER (WHERE entity_type = 'org'), '')
  AS oe, coalesce(max(l) FILTER (WHERE entity_type = 'tech_stack'), '') AS te FROM et GROUP BY 1),
ctx AS (SELECT coalesce(co.company_id, en.company_id) AS company_id, coalesce(content, '') AS content, coalesce(tc, '') AS
  team_content, coalesce(cc, '') AS careers_content, coalesce(e, '') AS entities, coalesce(pe, '') AS people_entities,
  coalesce(oe, '') AS org_entities, coalesce(te, '') AS tech_entities FROM co FULL OUTER JOIN en
  ON co.company_id = en.company_id)"""


@query("context_assembly", f"{context_sql} SELECT * FROM ctx")
def context_assembly(t):
    return A.context_assembly(*_context(t), page_chars=5_000, content_chars=50_000, part_chars=10_000, list_chars=5_000)


def _context(t):
    pages = t.v_site_texts.withColumn("page_type", C.page_type_first_match(F.col("url")))
    ents = t.v_entities.withColumn("company_id", F.concat(F.lit("src"), F.substring("company_id", F.lit(2), F.lit(20))))
    return pages, ents


@query("context_rows", f"""WITH st AS (SELECT page_id, company_id, url, text, lower({O.path('url')}) AS p FROM v_site_texts)
SELECT company_id, 'page' AS kind, {first_type_sql} AS type, page_id AS position, '[' || url || ']' || chr(10) || text ||
  chr(10) AS piece FROM st WHERE coalesce(text, '') <> ''
UNION ALL SELECT 'src' || substr(company_id, 2), 'entity', entity_type, entity_id, {_label} FROM v_entities""")
def context_rows(t):
    """All texts and entities of each company, whole."""
    return A.context_rows(*_context(t))
