"""List queries."""

from pyspark.sql import functions as F

from sitebrief.functions import scalars as S
from sitebrief.operators import listing as L
from sitebrief.plans.registry import query
from sitebrief.plans.scalar_plans import _in, _out

_co = "company_id, company_name, website_url, status, tokens"


@query("company_list", f"SELECT {_co} FROM v_companies WHERE status = 'pending' AND (company_name ILIKE '%1%' OR "
       "website_url ILIKE '%1%') ORDER BY created_at DESC NULLS LAST, company_id LIMIT 20 OFFSET 20")
def company_list(t):
    df = L.companies(t.v_companies, "pending", "1")
    return L.page(df, L.sort_keys(df, "created_at", "desc", "company_id"), 2, 20).select(*_co.split(", "))


@query("company_list_sorted", f"SELECT {_co} FROM v_companies ORDER BY tokens ASC NULLS FIRST, company_id LIMIT 100")
def company_list_sorted(t):
    df = L.companies(t.v_companies, "no such state")
    return L.page(df, L.sort_keys(df, "tokens", "asc", "company_id"), 0, 1000, max_size=100).select(*_co.split(", "))


@query("company_list_totals", """SELECT count(*) AS total, CAST(CASE WHEN count(*) > 0 THEN ceil(count(*) / 20.0) ELSE 1
  END AS BIGINT) AS total_pages FROM v_companies WHERE status = 'pending'
  AND (company_name ILIKE '%1%' OR website_url ILIKE '%1%')""")
def company_list_totals(t):
    return L.totals(L.companies(t.v_companies, "pending", "1"))


@query("entity_list", """SELECT entity_id, entity_type, entity_value, round(confidence, 6) AS confidence FROM v_entities
  WHERE company_id = 'c0' AND entity_type = 'email' AND confidence >= 0.7
  ORDER BY v_entities.confidence DESC, entity_id LIMIT 50 OFFSET 50""")
def entity_list(t):
    df = L.entities(t.v_entities, "c0", "email", 0.7)
    out = L.page(df, [F.desc("confidence"), F.asc("entity_id")], 2, 50)
    return out.select("entity_id", "entity_type", "entity_value", F.round("confidence", 6).alias("confidence"))


@query("page_list", """SELECT page_id, url, page_type, is_external FROM v_pages WHERE company_id = 'c0' AND
  page_type = 'team' ORDER BY crawled_at DESC, page_id LIMIT 20""")
def page_list(t):
    df = L.pages(t.v_pages, "c0", "team")
    return L.page(df, [F.desc("crawled_at"), F.asc("page_id")]).select("page_id", "url", "page_type", "is_external")


@query("batch_list", """SELECT batch_id, status, priority, (SELECT count(*) FROM v_batches WHERE status = 'processing') AS
  total FROM v_batches WHERE status = 'processing' ORDER BY created_at DESC, batch_id LIMIT 5 OFFSET 2""")
def batch_list(t):
    df = t.v_batches.filter("status = 'processing'")
    rows = df.orderBy(F.desc("created_at"), "batch_id").offset(2).limit(5).select("batch_id", "status", "priority")
    total = df.groupBy("status").agg(F.count("*").alias("total"))
    return rows.join(total, "status")


@query("batch_members", """SELECT company_id, company_name, status FROM v_companies WHERE batch_id = 'b3' AND
  status = 'completed' ORDER BY created_at, company_id LIMIT 10""")
def batch_members(t):
    df = t.v_companies.filter("batch_id = 'b3' AND status = 'completed'")
    return df.orderBy("created_at", "company_id").limit(10).select("company_id", "company_name", "status")


@query("jobs_by_status", "SELECT company_id, phase FROM v_companies WHERE status = 'in_progress' ORDER BY company_id "
       "LIMIT 100")
def jobs_by_status(t):
    df = t.v_companies.filter("status = 'in_progress'")
    return df.orderBy("company_id").limit(100).select("company_id", "phase")


@query("usage_history", f"""SELECT usage_id, call_type, section, input_tokens, output_tokens, input_tokens + output_tokens
  AS total_tokens, round({_in} + {_out}, 6) AS total_cost FROM v_usages WHERE company_id = 'c0'
  ORDER BY ts DESC, usage_id LIMIT 100""")
def usage_history(t):
    df = t.v_usages.filter("company_id = 'c0'").orderBy(F.desc("ts"), "usage_id").limit(100)
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return df.select("usage_id", "call_type", "section", "input_tokens", "output_tokens", (i + o).alias("total_tokens"),
                     F.round(S.total_cost(i, o), 6).alias("total_cost"))


@query("expired_batches", """SELECT batch_id, status FROM v_batches WHERE status IN ('completed', 'cancelled') AND
  completed_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY""")
def expired_batches(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return L.expired_batches(t.v_batches, now).select("batch_id", "status")
