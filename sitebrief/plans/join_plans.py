"""Join queries, robots rules and sitemaps."""

from pyspark.sql import functions as F

from sitebrief.functions import urls as U
from sitebrief.operators import joins as J
from sitebrief.operators import listing as L
from sitebrief.operators import pages as pages_op
from sitebrief.operators.versions import section_changes, version_pairs
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.page_plans import ORACLE_LINKS
from sitebrief.plans.registry import query
from sitebrief.plans.scalar_plans import repaired_sql
from sitebrief.session import cut_lineage
from sitebrief.sources import robots as R
from sitebrief.sources import sitemaps as M

_up = "rtrim(" + O.with_scheme(O.strip("website_url")) + ", '/')"


def _new_rows(t):
    return t.v_uploads.select("row_no", U.with_scheme(U.strip(F.col("website_url"))).alias("website_url"))


_known = "k AS (SELECT rtrim(website_url, '/') AS key, min(company_id) AS existing_id FROM v_companies GROUP BY 1)"
_newrows = f"u AS (SELECT row_no, {O.with_scheme(O.strip('website_url'))} AS website_url, {_up} AS key FROM v_uploads)"


@query("registry_conflicts", f"WITH {_known}, {_newrows} SELECT row_no, website_url, existing_id FROM u JOIN k USING (key)")
def registry_conflicts(t):
    return J.registry_conflicts(_new_rows(t), t.v_companies)


@query("registry_new", f"WITH {_known}, {_newrows} SELECT row_no, website_url FROM u ANTI JOIN k USING (key)")
def registry_new(t):
    return J.registry_new(_new_rows(t), t.v_companies)


@query("company_detail", """WITH a AS (SELECT company_id, max(version) AS version,
  arg_max(coalesce(executive_summary, chr(0)), version) AS s FROM v_analyses GROUP BY 1),
e AS (SELECT company_id, count(*) AS n FROM v_entities GROUP BY 1),
p AS (SELECT company_id, count(*) AS n FROM v_pages GROUP BY 1)
SELECT c.company_id, c.company_name, a.version, nullif(a.s, chr(0)) AS executive_summary,
  coalesce(e.n, 0) AS entity_count, coalesce(p.n, 0) AS page_count FROM v_companies c LEFT JOIN a USING (company_id)
  LEFT JOIN e ON e.company_id = c.company_id LEFT JOIN p ON p.company_id = c.company_id""")
def company_detail(t):
    df = J.company_detail(t.v_companies.select("company_id", "company_name"), t.v_analyses, t.v_entities, t.v_pages)
    return df.select("company_id", "company_name", "version", "executive_summary", "entity_count", "page_count")


_doomed = "d AS (SELECT company_id FROM v_companies WHERE status = 'failed')"


@query("cascade_delete", f"""WITH {_doomed} SELECT 'pages' AS table_name, count(*) AS deleted FROM v_pages
  SEMI JOIN d USING (company_id) UNION ALL SELECT 'entities', count(*) FROM v_entities SEMI JOIN d USING (company_id)
  UNION ALL SELECT 'analyses', count(*) FROM v_analyses SEMI JOIN d USING (company_id)
  UNION ALL SELECT 'sessions', count(*) FROM v_sessions SEMI JOIN d USING (company_id)""")
def cascade_delete(t):
    children = {"pages": t.v_pages, "entities": t.v_entities, "analyses": t.v_analyses, "sessions": t.v_sessions}
    return J.cascade_delete(t.v_companies.filter("status = 'failed'"), children)[1]


@query("cascade_delete_rows", f"WITH {_doomed} SELECT entity_id, company_id FROM v_entities ANTI JOIN d USING (company_id)")
def cascade_delete_rows(t):
    kept, _ = J.cascade_delete(t.v_companies.filter("status = 'failed'"), {"entities": t.v_entities})
    return kept["entities"].select("entity_id", "company_id")


@query("batch_cleanup", """WITH x AS (SELECT batch_id FROM v_batches WHERE status IN ('completed', 'cancelled') AND
  completed_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY)
SELECT company_id, CASE WHEN batch_id IN (SELECT batch_id FROM x) THEN NULL ELSE batch_id END AS batch_id
FROM v_companies""")
def batch_cleanup(t):
    expired = L.expired_batches(t.v_batches, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return J.batch_cleanup(t.v_companies, expired).select("company_id", "batch_id")


# --- robots -----------------------------------------------------------------------------------

rules_sql = f"""rl AS (SELECT domain, content, unnest(string_split(content, chr(10))) AS l,
  generate_subscripts(string_split(content, chr(10)), 1) AS i FROM v_robots),
rp AS (SELECT domain, i, {O.strip("string_split(l, '#')[1]")} AS l FROM rl),
rk AS (SELECT domain, i, lower({O.strip("regexp_extract(l, '^([^:]*):', 1)")}) AS key,
  {O.strip("regexp_extract(l, '^[^:]*:(.*)$', 1)")} AS value FROM rp WHERE contains(l, ':')),
ra AS (SELECT *, last_value(CASE WHEN key = 'user-agent' THEN CASE WHEN lower(value) IN ('*', '{R.AGENT}')
  THEN lower(value) ELSE '' END END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY i) AS ua FROM rk),
rr AS (SELECT domain, i, key AS kind, value AS pattern, ua FROM ra WHERE key IN ('allow', 'disallow') AND value <> ''
  AND ua <> ''),
rd AS (SELECT domain, ua, arg_max(try_cast(value AS DOUBLE), i) AS delay FROM ra WHERE key = 'crawl-delay' AND ua <> ''
  AND try_cast(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2),
pick AS (SELECT r.domain, CASE WHEN r.domain IN (SELECT domain FROM rr WHERE ua = '{R.AGENT}') OR r.domain IN
  (SELECT domain FROM rd WHERE ua = '{R.AGENT}' AND delay <> 0) THEN '{R.AGENT}' ELSE '*' END AS agent FROM v_robots r),
picked AS (SELECT p.domain, p.agent, d.delay AS crawl_delay FROM pick p LEFT JOIN rd d ON d.domain = p.domain AND
  d.ua = p.agent),
rules AS (SELECT p.domain, p.agent, p.crawl_delay, r.kind, r.pattern, r.i FROM picked p JOIN rr r ON
  r.domain = p.domain AND r.ua = p.agent)"""


@query("robots_rules_table", f"""WITH {rules_sql} SELECT domain, agent, crawl_delay, kind, pattern FROM rules
UNION ALL SELECT p.domain, p.agent, p.crawl_delay, 'sitemap', k.value FROM picked p JOIN rk k ON k.domain = p.domain AND
  k.key = 'sitemap' AND {O.http('k.value')}""")
def robots_rules_table(t):
    return R.rules_table(t.v_robots).select("domain", "agent", "crawl_delay", "kind", "pattern")


_rpath = f"{O.path('url')} || CASE WHEN {O.query('url')} <> '' THEN '?' || {O.query('url')} ELSE '' END"
_regex = ("'^' || replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([\\\\.\\[\\](){}+?^|$])', '\\\\\\1', 'g'), "
          "'*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END")


@query("robots_allowed", f"""WITH {rules_sql},
u AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]+)', 1) AS domain, {_rpath} AS p FROM pages),
m AS (SELECT page_id, length(pattern) AS n, kind FROM u JOIN rules USING (domain) WHERE regexp_matches(p, {_regex})),
b AS (SELECT page_id, max(n * 2 + CASE kind WHEN 'disallow' THEN 1 ELSE 0 END) AS best FROM m GROUP BY 1)
SELECT u.page_id, u.url, coalesce(best % 2 = 0, true) AS allowed FROM u LEFT JOIN b USING (page_id)""")
def robots_allowed(t):
    urls = t.pages.select("page_id", "url", U.domain(F.col("url")).alias("domain"))
    return R.check_urls(urls, t.v_robots).select("page_id", "url", "allowed")


@query("crawl_delay_lookup", f"""WITH {rules_sql} SELECT page_id, crawl_delay,
  greatest(coalesce(crawl_delay, 0), 1.0)::DOUBLE AS effective_delay FROM pages
  LEFT JOIN picked ON domain = regexp_extract(url, '//([^/?#]+)', 1)""")
def crawl_delay_lookup(t):
    urls = t.pages.select("page_id", "url", U.domain(F.col("url")).alias("domain"))
    df = R.check_urls(urls, t.v_robots)
    return df.select("page_id", "crawl_delay", R.effective_delay(F.col("crawl_delay")).alias("effective_delay"))


# --- sitemaps ---------------------------------------------------------------------------------

sitemap_sql = """sd AS (SELECT doc_id, sitemap_url, xml FROM v_sitemaps WHERE NOT contains(xml, 'broken')
  AND NOT contains(xml, '<feed>')),
se AS (SELECT sitemap_url, xml, unnest(regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1)) AS b,
  generate_subscripts(regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1), 1) AS i FROM sd),
su0 AS (SELECT sitemap_url, xml, i, trim(regexp_extract(b, '<loc>(.*?)</loc>', 1)) AS url,
  nullif(regexp_extract(b, '<lastmod>(.*?)</lastmod>', 1), '') AS lastmod,
  nullif(regexp_extract(b, '<changefreq>(.*?)</changefreq>', 1), '') AS changefreq,
  try_cast(nullif(regexp_extract(b, '<priority>(.*?)</priority>', 1), '') AS DOUBLE) AS priority FROM se),
su AS (SELECT *, row_number() OVER (PARTITION BY sitemap_url, url ORDER BY i) AS rn FROM su0 WHERE url <> ''),
surls AS (SELECT * FROM su WHERE contains(xml, 'xmlns') OR rn = 1)"""


@query("sitemap_urls_table", f"""WITH {sitemap_sql} SELECT sitemap_url, url,
  strftime(CAST(lastmod AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS lastmod, changefreq, priority FROM surls""")
def sitemap_urls_table(t):
    df = M.urls_table(t.v_sitemaps.select("sitemap_url", "xml"))
    return df.select("sitemap_url", "url", F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss").alias("lastmod"),
                     "changefreq", "priority")


@query("sitemap_expand", f"""WITH RECURSIVE {sitemap_sql},
kids AS (SELECT sitemap_url, unnest(regexp_extract_all(xml, '<loc>(.*?)</loc>', 1)) AS child,
  generate_subscripts(regexp_extract_all(xml, '<loc>(.*?)</loc>', 1), 1) AS i FROM sd WHERE contains(xml, '<sitemapindex')),
walk AS (SELECT sitemap_url AS root, sitemap_url, 0 AS lvl, '' AS path FROM v_sitemaps WHERE is_root
  UNION ALL SELECT w.root, k.child, w.lvl + 1, w.path || chr(CAST(48 + k.i AS INT)) FROM walk w
  JOIN kids k ON k.sitemap_url = w.sitemap_url WHERE k.child <> w.sitemap_url AND k.child <> w.root AND w.lvl < 12),
files AS (SELECT root, sitemap_url, min(lpad(lvl::VARCHAR, 3, '0') || path) AS met FROM walk GROUP BY 1, 2),
kept AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY met) AS rn FROM files),
outp AS (SELECT k.root, k.sitemap_url, s.url, row_number() OVER (PARTITION BY k.root ORDER BY k.rn, s.i) AS n
  FROM kept k JOIN surls s USING (sitemap_url))
SELECT root, n, sitemap_url, url FROM outp""")
def sitemap_expand(t):
    docs = t.v_sitemaps
    roots = docs.filter("is_root").select(F.col("sitemap_url").alias("root"))
    return M.expand(docs.select("sitemap_url", "xml"), roots)


@query("unvisited_links", f"""WITH {ORACLE_LINKS}, l AS (SELECT DISTINCT regexp_extract(url, '//([^/?#]+)', 1) AS site,
  link FROM lnk JOIN pages USING (page_id)),
s AS (SELECT link, site FROM l WHERE length(link) % 3 = 0)
SELECT site, link FROM l ANTI JOIN s USING (site, link)
WHERE link NOT IN (SELECT rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') FROM pages)""")
def unvisited_links(t):
    # HTML is parsed once; the links serve twice.
    pages = t.v_markup.withColumn("site", U.netloc(F.col("url")))
    links = cut_lineage(pages_op.links(pages, ("site",)).select("site", "link"))
    visited = t.pages.select(U.netloc(F.col("url")).alias("site"), U.crawl_form(F.col("url")).alias("link"))
    # Stand-in for the queue: links whose length is a multiple of three count as queued.
    seen = links.filter(F.length("link") % 3 == 0)
    return J.unvisited_links(links, visited, seen)


# --- versions, progress, state ------------------------------------------------------------------

_pairs = """pr AS (SELECT company_id, max(version) AS cur, max(version) FILTER (WHERE rk = 2) AS prev FROM (SELECT
  company_id, version, row_number() OVER (PARTITION BY company_id ORDER BY version DESC) AS rk FROM v_analyses)
  GROUP BY company_id HAVING count(*) >= 2)"""


_changes = f"""{_pairs},
vs AS (SELECT v.company_id, CASE WHEN version = cur THEN 1 ELSE 0 END AS side, full_analysis AS doc, executive_summary AS summary
  FROM v_versions v JOIN pr ON pr.company_id = v.company_id AND (version = cur OR version = prev)),
sc AS (SELECT company_id, side, e.key AS section, e.value::VARCHAR AS v, e.type AS k FROM vs, json_each(vs.doc) e
  WHERE doc IS NOT NULL AND e.type <> 'NULL'),
sp AS (SELECT company_id, section, max(v) FILTER (side = 0) AS p, max(v) FILTER (side = 1) AS c,
  max(CASE WHEN k IN ('OBJECT', 'ARRAY') THEN lower(k) ELSE 'value' END) FILTER (side = 0) AS pk,
  max(CASE WHEN k IN ('OBJECT', 'ARRAY') THEN lower(k) ELSE 'value' END) FILTER (side = 1) AS ck FROM sc GROUP BY 1, 2),
sk AS (SELECT *, CASE WHEN pk IS NULL THEN ck WHEN ck IS NULL OR pk = ck THEN pk ELSE 'value' END AS kind FROM sp),
pi AS (SELECT company_id, section, kind, 0 AS side, e.key AS key, e.value::VARCHAR AS v FROM sk, json_each(sk.p) e WHERE kind <> 'value' AND p IS NOT NULL
  UNION ALL SELECT company_id, section, kind, 1, e.key, e.value::VARCHAR FROM sk, json_each(sk.c) e WHERE kind <> 'value' AND c IS NOT NULL),
pf AS (SELECT company_id, section, kind, CASE WHEN kind = 'object' THEN key ELSE v END AS field, side,
  CASE WHEN kind = 'object' AND v = 'null' THEN NULL ELSE v END AS v FROM pi),
ps AS (SELECT company_id, section, kind, field, max(v) FILTER (side = 0) AS p, max(v) FILTER (side = 1) AS c FROM pf GROUP BY 1, 2, 3, 4),
es AS (SELECT company_id, max(summary) FILTER (side = 0) AS p, max(summary) FILTER (side = 1) AS c FROM vs GROUP BY 1),
ch AS (SELECT company_id, section, kind, field, p AS previous_value, c AS current_value, CASE WHEN p IS NULL THEN 'added' WHEN c IS NULL
    THEN 'removed' ELSE 'modified' END AS change_type FROM ps WHERE p IS DISTINCT FROM c
  UNION ALL SELECT company_id, section, kind, section, p, c, CASE WHEN coalesce(p, '[]') = '[]' THEN 'added' WHEN coalesce(c, '[]') = '[]' THEN
    'removed' ELSE 'modified' END FROM sk WHERE kind = 'value' AND p IS DISTINCT FROM c
  UNION ALL SELECT company_id, 'executiveSummary', 'summary', 'executiveSummary', nullif(substr(p, 1, 100), ''), nullif(substr(c, 1, 100), ''),
    CASE WHEN coalesce(c, '') = '' THEN 'removed' WHEN coalesce(p, '') = '' THEN 'added' ELSE 'modified' END FROM es WHERE p IS DISTINCT FROM c)"""


def _section_changes(t):
    versions = t.v_versions
    return section_changes(version_pairs(versions), versions)


@query("version_diff_map", f"WITH {_changes} SELECT * FROM ch WHERE kind <> 'array'")
def version_diff_map(t):
    """Changed keys, values and summaries between each company's two newest versions."""
    return _section_changes(t).filter("kind <> 'array'")


@query("version_diff_list", f"WITH {_changes} SELECT company_id, section, field AS item, change_type FROM ch WHERE kind = 'array'")
def version_diff_list(t):
    """Items of listed sections that were added or removed."""
    return _section_changes(t).filter("kind = 'array'").select("company_id", "section", F.col("field").alias("item"), "change_type")


_last_session = """ls AS (SELECT company_id, session_id, pages_crawled, pages_queued, checkpoint FROM (SELECT *,
  row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, session_id DESC) AS rn FROM v_sessions) x
  WHERE rn = 1)"""


@query("progress_merge", f"""WITH {_last_session},
lv AS (SELECT 'c' || job_id AS company_id, count(*) AS pages_crawled, CAST(sum(CASE WHEN event_type = 'click' THEN
  external_links END) AS BIGINT) AS pages_queued FROM v_events GROUP BY 1)
SELECT ls.company_id, coalesce(lv.pages_crawled, ls.pages_crawled) AS pages_crawled,
  coalesce(lv.pages_queued, ls.pages_queued) AS pages_queued FROM ls LEFT JOIN lv USING (company_id)""")
def progress_merge(t):
    stored = J.latest(t.v_sessions, "company_id", ["created_at", "session_id"], ["pages_crawled", "pages_queued"])
    live = t.v_events.groupBy(F.concat(F.lit("c"), "job_id").alias("company_id")).agg(
        F.count("*").alias("pages_crawled"),
        F.sum(F.when(F.col("event_type") == "click", F.col("external_links"))).alias("pages_queued"))
    return J.progress_merge(stored, live, "company_id", ["pages_crawled", "pages_queued"])


@query("batch_assign", """SELECT c.company_id, 'new-batch' AS batch_id, CASE WHEN seq % 2 = 0 THEN '25' ELSE '100' END AS
  max_pages, (SELECT count(*) FROM v_companies WHERE company_id IN (SELECT 'c' || o_custkey * 2 FROM orders)) AS
  total FROM v_companies c WHERE c.company_id IN (SELECT 'c' || o_custkey * 2 FROM orders)""")
def batch_assign(t):
    ids = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey") * 2).alias("company_id"))
    base = F.create_map(F.lit("maxPages"), F.lit("100"))
    over = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("maxPages"), F.lit("25")))
    df = J.batch_assign(t.v_companies, ids, "new-batch", over, base)
    total = df.agg(F.count("*")).scalar()  # one row, read as a value
    return df.select("company_id", "batch_id", F.col("config")["maxPages"].alias("max_pages"), total.alias("total"))


@query("job_state", f"""WITH {_last_session}, {repaired_sql}
SELECT c.company_id, c.status, c.phase, c.paused_ms, ls.session_id, CASE WHEN ls.checkpoint IS NOT NULL THEN
  array_to_string(r.visited, ' ') END AS visited, CASE WHEN ls.checkpoint IS NOT NULL THEN r.entities END AS entities
FROM v_companies c LEFT JOIN ls USING (company_id) LEFT JOIN repaired r ON r.session_id = ls.session_id""")
def job_state(t):
    df = J.job_state(t.v_companies, t.v_sessions)
    return df.select("company_id", "status", "phase", "paused_ms", "session_id",
                     F.array_join("c.visited", " ").alias("visited"), F.col("c.entities").alias("entities"))
