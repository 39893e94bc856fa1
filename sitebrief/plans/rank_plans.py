"""Window, ranking and top-k queries."""

from pyspark.sql import functions as F

from sitebrief.functions import text as X
from sitebrief.functions import urls as U
from sitebrief.operators import joins as J
from sitebrief.operators import ranking as K
from sitebrief.operators.checkpoints import checkpoint_points as points
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.join_plans import _last_session, rules_sql
from sitebrief.plans.registry import query
from sitebrief.plans.scalar_plans import repaired_sql
from sitebrief.sources import robots as R


@query("latest_version", "SELECT company_id, max(version) AS version, arg_max(total_input, version) AS total_input "
       "FROM v_analyses GROUP BY company_id")
def latest_version(t):
    return J.latest(t.v_analyses, "company_id", ["version"], ["version", "total_input"])


@query("version_at", """WITH w AS (SELECT company_id, min(version) AS v FROM v_analyses GROUP BY 1 HAVING count(*) > 10),
n AS (SELECT a.company_id, coalesce(max(w.v), max(version)) AS version FROM v_analyses a LEFT JOIN w USING (company_id)
  GROUP BY 1) SELECT company_id, version, total_input FROM v_analyses SEMI JOIN n USING (company_id, version)""")
def version_at(t):
    wanted = t.v_analyses.groupBy("company_id").agg(F.min("version").alias("wanted_version"), F.count("*").alias("n"))
    return K.version_at(t.v_analyses, wanted.filter("n > 10").drop("n")).select("company_id", "version", "total_input")


@query("version_number", "SELECT company_id, version, row_number() OVER (PARTITION BY company_id ORDER BY version) AS "
       "version_number FROM v_analyses")
def version_number(t):
    return K.version_number(t.v_analyses).select("company_id", "version", "version_number")


@query("version_retention", """SELECT company_id, version FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY
  version DESC) AS rn FROM v_analyses) x WHERE rn <= 3""")
def version_retention(t):
    return K.retention(t.v_analyses).select("company_id", "version")


@query("latest_session", f"WITH {_last_session} SELECT company_id, session_id, pages_crawled FROM ls")
def latest_session(t):
    return J.latest(t.v_sessions, "company_id", ["created_at", "session_id"], ["session_id", "pages_crawled"])


@query("key_pages", """SELECT company_id, page_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CASE
  page_type WHEN 'about' THEN 1 WHEN 'team' THEN 2 WHEN 'product' THEN 3 WHEN 'service' THEN 4 WHEN 'contact' THEN 5 ELSE
  100 END, page_id) AS rn FROM v_pages) x WHERE rn <= 10""")
def key_pages(t):
    return K.key_pages(t.v_pages, 10).select("company_id", "page_id", F.col("rn").cast("bigint").alias("rn"))


@query("key_executives", """SELECT company_id, entity_value, role FROM (SELECT *, row_number() OVER (PARTITION BY company_id
  ORDER BY entity_id) AS rn FROM v_entities WHERE entity_type = 'person' AND role <> '') x WHERE rn <= 10""")
def key_executives(t):
    return K.key_executives(t.v_entities, 10).select("company_id", "entity_value", "role")


@query("frontier_topk", """SELECT site, url, rn FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, depth,
  ord, url) AS rn FROM v_frontier WHERE NOT visited) x WHERE rn <= 20""")
def frontier_topk(t):
    return K.frontier_topk(t.v_frontier, 20).select("site", "url", F.col("rn").cast("bigint").alias("rn"))


_budget = """bl AS (SELECT job_id, event_id, ts, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn,
  epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job_id) AS us FROM v_events)"""


@query("crawl_budget", f"WITH {_budget} SELECT job_id, event_id, rn FROM bl WHERE rn <= 40 AND us < 2000000 * 1000000::BIGINT")
def crawl_budget(t):
    return K.crawl_budget(t.v_events, 40, 2_000_000)[0].select("job_id", "event_id", F.col("rn").cast("bigint").alias("rn"))


@query("crawl_budget_reason", f"""WITH {_budget}, p AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE rn <= 40 AND
  us < 2000000 * 1000000::BIGINT) AS pages FROM bl GROUP BY 1) SELECT job_id, pages, CASE WHEN pages >= 40 THEN 'max_pages'
  WHEN pages < n THEN 'max_time' ELSE 'completed' END AS reason FROM p""")
def crawl_budget_reason(t):
    return K.crawl_budget(t.v_events, 40, 2_000_000)[1]


@query("exact_duplicates", f"""WITH h AS (SELECT doc_id AS page_id, source AS site, {O.content_hash('text')} AS hash
  FROM documents) SELECT page_id, site, hash, CASE WHEN row_number() OVER (PARTITION BY site, hash ORDER BY page_id) > 1
  THEN 'Duplicate content' END AS error FROM h""")
def exact_duplicates(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"),
                               X.content_hash(F.col("text")).alias("hash"))
    return K.exact_duplicates(pages).select("page_id", "site", "hash", "error")


upload_sql = f"""u0 AS (SELECT row_no, {O.strip('company_name')} AS name, {O.strip('website_url')} AS url, industry FROM
  v_uploads),
u1 AS (SELECT *, {O.with_scheme('url')} AS full_url, rtrim({O.with_scheme('url')}, '/') AS key FROM u0),
u2 AS (SELECT *, CASE WHEN name = '' THEN 'Company name is required' WHEN length(name) > 200 THEN
  'Company name exceeds 200 characters' WHEN url = '' THEN 'URL is required' WHEN NOT regexp_matches(full_url,
  {O.lit(U.UPLOAD_URL)}) THEN 'Invalid URL format' WHEN key IN (SELECT rtrim(website_url, '/') FROM v_companies) THEN
  'Company with URL ' || key || ' already exists' WHEN length({O.strip('industry')}) > 100 THEN
  'Industry exceeds 100 characters' END AS e FROM u1),
checked AS (SELECT row_no, CASE WHEN name = '' THEN 'Row ' || row_no ELSE name END AS company_name, CASE WHEN url <> '' AND
  coalesce(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY row_no ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'Duplicate URL in batch' ELSE e END AS error FROM u2)"""


@query("upload_row_check", f"WITH {upload_sql} SELECT row_no, company_name, error IS NULL AS accepted, error FROM checked")
def upload_row_check(t):
    return K.upload_row_check(t.v_uploads, t.v_companies).select("row_no", "company_name", "accepted", "error")


WORKERS = 50  # companies that may be in progress at a time; a number of workers, not of rows


def _fair_sql(only=""):
    return f"""WITH bz AS (SELECT batch_id, count(*) AS n FROM v_queue WHERE status = 'in_progress' GROUP BY 1),
sl AS (SELECT b.batch_id, priority, b.created_at AS bc, max_concurrent - coalesce(n, 0) AS slots FROM v_batches b LEFT JOIN
  bz USING (batch_id) WHERE b.status = 'processing' {only}),
w AS (SELECT c.company_id, sl.*, row_number() OVER (PARTITION BY c.batch_id ORDER BY c.created_at, c.company_id) AS rn FROM
  v_queue c JOIN sl USING (batch_id) WHERE c.status = 'pending'),
r AS (SELECT *, row_number() OVER (ORDER BY rn, priority, bc, batch_id) AS pick FROM w WHERE rn <= slots)
SELECT company_id, batch_id, pick FROM r WHERE pick <= {WORKERS} - (SELECT count(*) FROM v_queue WHERE status = 'in_progress')"""


@query("fair_share_topk", _fair_sql())
def fair_share_topk(t):
    return K.fair_share(t.v_queue, t.v_batches, WORKERS).select("company_id", "batch_id", "pick")


@query("batch_slots_topk", _fair_sql("AND b.batch_id = 'b1'"))
def batch_slots_topk(t):
    return K.fair_share(t.v_queue, t.v_batches, WORKERS, "b1").select("company_id", "batch_id", "pick")


@query("phase_transitions", """WITH l AS (SELECT job_id, event_id, phase, lag(phase) OVER (PARTITION BY job_id ORDER BY ts,
  event_id) AS previous FROM v_events) SELECT job_id, event_id, previous, phase FROM l WHERE previous IS NOT NULL AND
  previous || '>' || phase NOT IN ('queued>crawling', 'crawling>extracting', 'crawling>completed', 'extracting>analyzing',
  'analyzing>generating', 'generating>completed')""")
def phase_transitions(t):
    return K.phase_transitions(t.v_events).select("job_id", "event_id", "previous", "phase")


pause_sql = """pc AS (SELECT job_id, ts, event_id, control, lag(control) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS
  b FROM v_events WHERE control IS NOT NULL),
pt AS (SELECT job_id, control, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nxt
  FROM pc WHERE control IS DISTINCT FROM b),
pauses AS (SELECT job_id, CAST(coalesce(sum((nxt - us) // 1000), 0) AS BIGINT) AS paused_ms FROM pt WHERE control = 'pause'
  GROUP BY 1)"""


@query("pause_durations", f"WITH {pause_sql} SELECT * FROM pauses")
def pause_durations(t):
    return K.pause_durations(t.v_events)


@query("fetch_schedule", f"""WITH {rules_sql}, u AS (SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS domain FROM
  pages) SELECT page_id, u.domain, (row_number() OVER (PARTITION BY u.domain ORDER BY page_id) - 1) *
  greatest(coalesce(crawl_delay, 0), 1.0)::DOUBLE AS fetch_at FROM u LEFT JOIN picked USING (domain)""")
def fetch_schedule(t):
    urls = t.pages.select("page_id", "url", U.domain(F.col("url")).alias("domain"))
    df = R.check_urls(urls, t.v_robots).withColumn("effective_delay", R.effective_delay(F.col("crawl_delay")))
    return K.fetch_schedule(df).select("page_id", "domain", "fetch_at")


@query("fetch_gaps", """WITH g AS (SELECT job_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY
  ts, event_id)) / 1e6 AS gap FROM v_events) SELECT job_id, event_id, round(gap, 6) AS gap FROM g WHERE gap < 600""")
def fetch_gaps(t):
    return K.fetch_gaps(t.v_events, 600.0).select("job_id", "event_id", F.round("gap", 6).alias("gap"))


checkpoint_sql = """ev AS (SELECT job_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY job_id ORDER BY ts,
  event_id) - 1 AS i FROM v_events),
nx AS (SELECT job_id, i, CASE """ + " ".join(f"WHEN lead(t, {k}) OVER w - t >= 86400 * 1000000::BIGINT THEN i + {k}" for k in range(1, 10)) + """
  WHEN lead(t, 10) OVER w IS NOT NULL THEN i + 10 END AS nxt FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY i)),
st AS (SELECT b.job_id, min(b.i) AS i FROM ev a JOIN ev b ON a.job_id = b.job_id AND a.i = 0 AND (b.i = 9 OR
  b.t - a.t >= 86400 * 1000000::BIGINT) GROUP BY 1),
hop AS (SELECT job_id, i FROM st UNION ALL SELECT nx.job_id, nx.nxt FROM hop JOIN nx ON nx.job_id = hop.job_id AND
  nx.i = hop.i WHERE nx.nxt IS NOT NULL)"""


@query("checkpoint_points", f"WITH RECURSIVE {checkpoint_sql} SELECT hop.job_id, event_id, hop.i FROM hop JOIN ev ON "
       "ev.job_id = hop.job_id AND ev.i = hop.i")
def checkpoint_points(t):
    return points(t.v_events, pages=10, seconds=86400.0)


@query("resume_phase", f"""WITH {_last_session}, {repaired_sql},
x AS (SELECT r.* FROM ls JOIN repaired r USING (session_id) WHERE r.checkpoint IS NOT NULL AND r.checkpoint NOT IN
  ('{{}}', '[]')),
y AS (SELECT company_id, session_id, CASE WHEN len(sections) > 0 OR entities > 0 THEN 'analyzing' WHEN len(visited) > 0 THEN
  'extracting' WHEN len(queued) > 0 THEN 'crawling' ELSE 'queued' END AS phase FROM x)
SELECT *, CASE WHEN phase = 'crawling' THEN 'queued' ELSE phase END AS restart_phase, phase <> 'queued' AS can_resume
FROM y""")
def resume_phase(t):
    return K.resume_phase(t.v_sessions)
