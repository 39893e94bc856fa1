"""From page texts to stored entities and prompts: the operators in one chain."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.functions import extract as E
from sitebrief.functions import mentions as M
from sitebrief.functions import patterns as P
from sitebrief.operators import aggregates as A
from sitebrief.operators import dedup as D
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.aggregate_plans import _context, context_sql
from sitebrief.plans.dedup_plans import _merged, whole_sql
from sitebrief.plans.extract_plans import SECTION_ORDER, _structured
from sitebrief.plans.registry import query
from sitebrief.session import cut_lineage

ROOM = 1 << 30  # places of mentions on one page


def found_mentions(texts: DataFrame) -> DataFrame:
    """Everything that extraction finds on pages (company_id, page_id, source_url, text), as mentions for merging.

    Places count by type and value on a page; only their order matters, between values of equal length.
    """
    found = E.entities(texts.select("company_id", "page_id", "source_url", "text"), tech_stack=True)
    place = F.row_number().over(W.partitionBy("page_id").orderBy("type", "normalized"))
    return found.select(
        "company_id", (F.col("page_id") * ROOM + place).alias("pos"), "type", F.col("normalized").alias("value"),
        F.round("confidence", 6).alias("confidence"), "source_url", F.lit(None).cast("string").alias("context"),
        *[F.lit(None).cast("string").alias(k) for k in D.EXTRA_KEYS])


# Both parts of the check have a table ph.
_renamed = re.sub(r"\bph\b", "phd", whole_sql)
_found = f"""{_structured},
xm AS (SELECT v.company_id, page_id * {ROOM}::BIGINT + row_number() OVER (PARTITION BY page_id ORDER BY type, normalized) AS pos, type,
  normalized AS value, round(confidence, 6) AS confidence, source_url, NULL::VARCHAR AS context, NULL::VARCHAR AS role,
  NULL::VARCHAR AS relationship FROM allent JOIN v_texts v USING (page_id)),
{_renamed.replace('v_mentions', 'xm').replace("('product', 'location')", "('address', 'social_handle', 'tech_stack')")}"""


@query("site_entities", f"WITH RECURSIVE {_found} {_merged}")
def site_entities(t):
    """The merged entities of each company, extracted from its pages."""
    merged = D.merge(D.cluster_all(cut_lineage(found_mentions(t.v_texts))))
    return merged.withColumn("confidence", F.round("confidence", 6)).select(
        "company_id", "type", "cluster", "value", "confidence", "mentions", "n_sources", "n_contexts", "source_url", "role")


# Short templates of our own that use every variable; a user passes any others.
_LINES = [("content", "Pages"), ("entities", "Entities"), ("people_entities", "People"), ("org_entities", "Organizations"),
          ("tech_entities", "Technologies"), ("team_content", "Team pages"), ("careers_content", "Career pages"),
          ("previous_analysis", "Sections so far"), ("full_analysis", "Stored report")]
TEMPLATES = {s: f"Write the section {name} of {{company_name}} ({{website_url}}, {{industry}})." + "".join(
    f"\n{title}: {{{v}}}" for v, title in _LINES) for s, name, _ in P.SECTIONS}


def section_prompts(companies: DataFrame, context: DataFrame, previous: DataFrame, reports: DataFrame,
                    templates: dict[str, str], order: list[str]) -> DataFrame:
    """company_id, ord, section, prompt: each section's template with all its variables, for every company.

    context: what ``context_assembly`` gives (its limits bound a prompt); previous: company_id, section, previous_analysis;
    reports: company_id, full_analysis. What is missing is empty, a name ``Unknown Company``, an industry ``Unknown``.
    """
    told = previous.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "previous_analysis"))).alias("_previous"))
    df = companies.join(context, "company_id", "left").join(told, "company_id", "left").join(reports, "company_id", "left")
    plain = ["content", "entities", "people_entities", "org_entities", "tech_entities", "team_content", "careers_content", "full_analysis", "website_url"]
    values = {v: F.coalesce(v, F.lit("")) for v in plain}
    values["company_name"] = F.coalesce("company_name", F.lit("Unknown Company"))
    values["industry"] = F.coalesce("industry", F.lit("Unknown"))
    prompts = [F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(s).alias("section"), M.render(templates[s], values | {
        "previous_analysis": F.coalesce(F.col("_previous")[s], F.lit(""))}).alias("prompt")) for i, s in enumerate(order)]
    return df.select("company_id", F.inline(F.array(*prompts)))


_names = ", ".join(f"({i}, '{s}', {O.lit(dict((a, b) for a, b, _ in P.SECTIONS)[s])})" for i, s in enumerate(SECTION_ORDER))
_text_sql = "'Write the section ' || s.name || ' of ' || company_name || ' (' || website_url || ', ' || coalesce(industry, 'Unknown') || ').'" + "".join(
    f" || chr(10) || '{title}: ' || coalesce({v}, '')" for v, title in _LINES)


@query("section_prompts", f"""WITH {context_sql[5:]},
s(ord, section, name) AS (VALUES {_names}),
nr AS (SELECT 'src' || substr(company_id, 2) AS company_id, analysis_id, full_analysis FROM v_analyses QUALIFY row_number() OVER (
  PARTITION BY company_id ORDER BY version DESC) = 1),
rs AS (SELECT nr.company_id, x.place, n.name, content FROM v_section_results r JOIN nr USING (analysis_id) JOIN (SELECT section, ord AS place FROM s) x
  USING (section) JOIN s n USING (section) WHERE error IS NULL AND coalesce(content, '') <> ''),
pv AS (SELECT DISTINCT nr.company_id, r.section FROM v_section_results r JOIN nr USING (analysis_id) WHERE r.section IN ('key_insights', 'executive_summary')),
pa AS (SELECT pv.company_id, pv.section, string_agg('=== ' || rs.name || ' ===' || chr(10) || content, chr(10) || chr(10) ORDER BY rs.place) AS previous_analysis
  FROM pv JOIN s ON s.section = pv.section JOIN rs ON rs.company_id = pv.company_id AND rs.place < s.ord GROUP BY 1, 2)
SELECT c.company_id, CAST(s.ord AS BIGINT) AS ord, s.section, {_text_sql} AS prompt
FROM (SELECT 'src' || substr(company_id, 2) AS company_id, company_name, website_url, industry FROM v_companies) c CROSS JOIN s
LEFT JOIN ctx ON ctx.company_id = c.company_id LEFT JOIN nr ON nr.company_id = c.company_id
LEFT JOIN pa ON pa.company_id = c.company_id AND pa.section = s.section""")
def section_prompts_query(t):
    """Prompts of all companies from assembled contexts, earlier sections and stored reports."""
    key = F.concat(F.lit("src"), F.substring("company_id", F.lit(2), F.lit(20))).alias("company_id")
    context = A.context_assembly(*_context(t), page_chars=5_000, content_chars=50_000, part_chars=10_000, list_chars=5_000)
    newest = t.v_analyses.groupBy("company_id").agg(F.max_by(F.struct("analysis_id", "full_analysis"), "version").alias("r"))
    newest = newest.select(key, "r.*")
    previous = A.previous_sections_text(t.v_section_results, SECTION_ORDER).join(newest, "analysis_id").select("company_id", "section", "previous_analysis")
    companies = t.v_companies.select(key, "company_name", "website_url", "industry")
    return section_prompts(companies, context, previous, newest.select("company_id", "full_analysis"), TEMPLATES, SECTION_ORDER)
