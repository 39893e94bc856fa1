"""Streams over the driver's files, each with its batch twin as the check."""

import uuid

from pyspark.sql import functions as F

from sitebrief.functions import mentions as M
from sitebrief.plans.extract_plans import _mentions_sql, _structured, mention_columns
from sitebrief.plans.rank_plans import checkpoint_sql
from sitebrief.plans.registry import query
from sitebrief.plans.standins import STANDINS
from sitebrief.session import TABLE_SCHEMAS, scratch_path
from sitebrief.streaming import live as V


def _path(t, name):
    return scratch_path(t.spark, f"sitebrief-{name}")


def _events(t):
    """The run log as a stream: the same view as v_events, over streamed files."""
    raw = V.read_files(t.spark, t.sf_dir, TABLE_SCHEMAS["events"], "events.parquet")
    name = f"stream_{uuid.uuid4().hex}"
    raw.createOrReplaceTempView(name)
    return t.spark.sql(STANDINS["v_events"].replace("FROM events", f"FROM {name}"))


def _sites(t):
    return _events(t).withColumnRenamed("job_id", "site").select("site", "event_id", "ts", "url", "hash")


@query("stream_page_dedup", "SELECT DISTINCT 'url' AS kind, job_id AS site, url AS value FROM v_events UNION ALL "
       "SELECT DISTINCT 'hash', job_id, hash FROM v_events")
def stream_page_dedup(t):
    """Each URL and each text hash of a site once, over any span of time."""
    order = ["ts", "event_id"]
    urls = V.first_ever(_sites(t), _path(t, "urls"), [["site", "url"]], order)
    hashes = V.first_ever(_sites(t), _path(t, "hashes"), [["site", "hash"]], order)
    return urls.select(F.lit("url").alias("kind"), "site", F.col("url").alias("value")).unionByName(
        hashes.select(F.lit("hash").alias("kind"), "site", F.col("hash").alias("value")))


@query("stream_new_pages", """WITH u AS (SELECT * FROM v_events QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY ts, event_id) = 1)
SELECT job_id AS site, event_id, url, hash FROM u QUALIFY row_number() OVER (PARTITION BY job_id, hash ORDER BY ts, event_id) = 1""")
def stream_new_pages(t):
    """Pages whose URL and text are both new on their site."""
    out = V.first_ever(_sites(t), _path(t, "new-pages"), [["site", "url"], ["site", "hash"]], ["ts", "event_id"])
    return out.select("site", "event_id", "url", "hash")


_progress_sql = """SELECT job_id, count(*) AS crawled, count(*) FILTER (WHERE error IS NOT NULL OR status_code NOT BETWEEN 200 AND
  399) AS errors, count(*) FILTER (WHERE error = 'Duplicate content') AS duplicates, CAST(sum(external_links) AS BIGINT) AS
  external_links, arg_max(url, (ts, event_id)) AS current_url, epoch_us(max(ts)) AS last_us FROM v_events GROUP BY job_id"""


def _live(t):
    df = V.newest(V.run_updates(V.progress(_events(t)), _path(t, "progress")), "job_id")
    return df.withColumn("last_us", F.unix_micros("last_activity")).drop("last_activity")


@query("stream_progress", _progress_sql)
def stream_progress(t):
    return _live(t)


@query("stream_checkpoints", f"WITH RECURSIVE {checkpoint_sql} SELECT hop.job_id, event_id FROM hop JOIN ev ON ev.job_id = "
       "hop.job_id AND ev.i = hop.i")
def stream_checkpoints(t):
    return V.run_to_files(V.checkpoints(_events(t), 10, 86400.0), _path(t, "checkpoints"))


def _silence_sql(seconds):
    return f"""WITH g AS (SELECT job_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS
  nxt, max(epoch_us(ts)) OVER () - 600000000 AS wm FROM v_events)
SELECT job_id, us, 'stale' AS kind FROM g WHERE nxt - us > {seconds} * 1000000::BIGINT OR (nxt IS NULL AND
  wm - us > {seconds} * 1000000::BIGINT)"""


# A run lasts from one silence to the next. Each event holds until the next, the last of a run until the silence is noticed; the
# limit is reached where what was spent, pauses left out, passes it. The end of the log is as far as the watermark.
_limit_sql = """WITH e AS (SELECT job_id, event_id, ts, epoch_us(ts) AS us, control, lag(epoch_us(ts)) OVER j AS prv, lead(epoch_us(ts)) OVER j AS later,
  max(epoch_us(ts)) OVER () - 600000000 AS wm FROM v_events WINDOW j AS (PARTITION BY job_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CASE WHEN us - prv > 3600 * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM e),
p AS (SELECT *, coalesce(lead(us) OVER r, us + 3600 * 1000000::BIGINT) - us AS held, coalesce(last_value(control IGNORE NULLS) OVER
  (PARTITION BY job_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'resume') AS state FROM n
  WINDOW r AS (PARTITION BY job_id, run ORDER BY ts, event_id)),
a AS (SELECT *, CASE WHEN state = 'pause' THEN 0 ELSE held END AS active FROM p),
c AS (SELECT *, sum(active) OVER (PARTITION BY job_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM a),
d AS (SELECT job_id, run, CAST(min(us + active - (spent - 3600 * 1000000::BIGINT)) AS BIGINT) AS us, arg_min(later IS NULL, us) AS open, any_value(wm) AS wm
  FROM c WHERE spent > 3600 * 1000000::BIGINT GROUP BY 1, 2)
SELECT job_id, us, 'timeout' AS kind FROM d WHERE NOT open OR us < wm"""


@query("stream_stale_jobs", f"SELECT * FROM ({_silence_sql(3600)}) s UNION ALL SELECT * FROM ({_limit_sql}) l")
def stream_stale_jobs(t):
    """Jobs of which nothing was heard for an hour, and jobs that have run for one, pauses not counted."""
    return V.run_to_files(V.silent_jobs(_events(t), 3600, limit=3600, ahead=True), _path(t, "stale"))


@query("stream_job_timeouts", """WITH e AS (SELECT job_id, event_id, ts, epoch_us(ts) AS us, control, min(epoch_us(ts)) OVER (PARTITION BY job_id) AS first
  FROM v_events),
c AS (SELECT *, coalesce(lag(control) OVER w, 'resume') AS before FROM e WHERE control IS NOT NULL WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
k AS (SELECT *, lead(us) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS until FROM c WHERE control <> before),
z AS (SELECT job_id, event_id, sum(until - us) FILTER (control = 'pause') OVER w AS paused, control, us AS since FROM k
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
j AS (SELECT e.job_id, e.us, e.first, z.control, z.since, coalesce(z.paused, 0) - CASE WHEN z.control = 'pause' THEN coalesce(k.until - k.us, 0) ELSE 0 END AS paused
  FROM e ASOF LEFT JOIN (SELECT z.*, e2.ts FROM z JOIN e e2 ON e2.job_id = z.job_id AND e2.event_id = z.event_id) z ON e.job_id = z.job_id AND e.ts >= z.ts
  LEFT JOIN k ON k.job_id = z.job_id AND k.event_id = z.event_id),
o AS (SELECT job_id, us FROM j WHERE us - first - paused - CASE WHEN control = 'pause' THEN us - since ELSE 0 END > 864000 * 1000000::BIGINT)
SELECT job_id, min(us) AS us, 'timeout' AS kind FROM o GROUP BY job_id""")
def stream_job_timeouts(t):
    out = V.run_to_files(V.silent_jobs(_events(t), 10**7, limit=10 * 86400), _path(t, "timeouts"))
    return out.filter("kind = 'timeout'")


@query("stream_progress_ttl", _silence_sql(86400))
def stream_progress_ttl(t):
    return V.run_to_files(V.silent_jobs(_events(t), 86400), _path(t, "ttl"))


@query("stream_progress_live", f"WITH p AS ({_progress_sql}) SELECT job_id, crawled, last_us FROM p WHERE "
       "epoch_us(TIMESTAMP '2024-01-31 00:00:00') - last_us <= 86400 * 1000000::BIGINT")
def stream_progress_live(t):
    """The live view at a given time: rows a day old have vanished."""
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return _live(t).filter(now - F.col("last_us") <= 86_400_000_000).select("job_id", "crawled", "last_us")


@query("stream_extract", "WITH sdocs AS (SELECT doc_id AS page_id, text FROM documents), " + _structured.replace(
    "v_texts", "sdocs") + " SELECT page_id, type, normalized FROM allent WHERE type <> 'tech_stack'")
def stream_extract(t):
    docs = V.read_files(t.spark, t.sf_dir, TABLE_SCHEMAS["documents"], "documents.parquet")
    out = V.extract(docs.select(F.col("doc_id").alias("page_id"), "text"))
    return V.run_to_files(out, _path(t, "extract")).select("page_id", "type", "normalized")


@query("stream_mentions", _mentions_sql("(SELECT doc_id AS page_id, text FROM documents)"))
def stream_mentions(t):
    """Mentions of an unbounded stream of texts, by a model that each worker loads once."""
    docs = V.read_files(t.spark, t.sf_dir, TABLE_SCHEMAS["documents"], "documents.parquet")
    model = M.loaded("rules", lambda: M.rule_model)
    out = mention_columns(M.mention_extract(docs.select(F.col("doc_id").alias("page_id"), "text"), model))
    return V.run_to_files(out, _path(t, "mentions"))
