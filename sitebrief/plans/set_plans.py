"""Set operations."""

from pyspark.sql import functions as F

from sitebrief.functions import extract as E
from sitebrief.functions import mentions as M
from sitebrief.functions import patterns as P
from sitebrief.functions import scalars as S
from sitebrief.plans.extract_plans import _structured, conf_sql, type_sql
from sitebrief.plans.extract_plans import SECTION_ORDER
from sitebrief.plans.registry import query
from sitebrief.plans.scalar_plans import repaired_sql


@query("all_mentions", f"""WITH {_structured} SELECT {type_sql(P.LABELS)} AS type, value, round({conf_sql}, 6) AS confidence,
  'span ' || span_id AS origin FROM v_spans WHERE {type_sql(P.LABELS)} IS NOT NULL AND round({conf_sql}, 6) >= 0.5
UNION ALL SELECT type, normalized, round(confidence, 6), 'page ' || page_id FROM allent WHERE type <> 'tech_stack'""")
def all_mentions(t):
    spans = t.v_spans.select(
        M.entity_type(F.col("label")).alias("type"), "value", F.round(M.confidence(F.col("value")), 6).alias("confidence"),
        F.concat(F.lit("span "), "span_id").alias("origin")).filter("type IS NOT NULL AND confidence >= 0.5")
    found = E.entities(t.v_texts.select("page_id", "text")).select(
        "type", F.col("normalized").alias("value"), F.round("confidence", 6).alias("confidence"),
        F.concat(F.lit("page "), "page_id").alias("origin"))
    return spans.unionByName(found)


_all_sections = ", ".join(f"('{s}')" for s in SECTION_ORDER)


@query("remaining_sections", f"""WITH {repaired_sql} SELECT session_id, s AS section FROM repaired, (VALUES {_all_sections}) x(s)
  WHERE NOT list_contains(sections, s)""")
def remaining_sections(t):
    every = F.array(*[F.lit(s) for s in SECTION_ORDER])
    c = S.checkpoint(F.col("checkpoint"))
    return t.v_sessions.select("session_id", F.explode(F.array_except(every, c["sections"])).alias("section"))


@query("pending_urls", "SELECT site, url FROM v_frontier EXCEPT SELECT site, url FROM v_frontier WHERE visited")
def pending_urls(t):
    seen = t.v_frontier.select("site", "url")
    return seen.subtract(t.v_frontier.filter("visited").select("site", "url"))


@query("visited_union", f"WITH {repaired_sql} SELECT DISTINCT company_id, unnest(visited) AS url FROM repaired")
def visited_union(t):
    c = S.checkpoint(F.col("checkpoint"))
    return t.v_sessions.select("company_id", F.explode(c["visited"]).alias("url")).distinct()
