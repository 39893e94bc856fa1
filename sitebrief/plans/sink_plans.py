"""Sources and sinks: what is written is read back and checked."""

from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.operators import dedup as D
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.dedup_plans import whole_sql
from sitebrief.plans.registry import query
from sitebrief.plans.scalar_plans import sections_sql
from sitebrief.session import cut_lineage, scratch_path, stored
from sitebrief.sources import briefs as B
from sitebrief.sources.company_csv import read_companies


def _out(t, name):
    return scratch_path(t.spark, f"sitebrief-{name}")


@query("company_csv_scan", "SELECT CAST(row_no AS VARCHAR) AS row_no, company_name, website_url, industry FROM v_uploads")
def company_csv_scan(t):
    path = _out(t, "csv")
    t.v_uploads.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return read_companies(t.spark, path).select("row_no", "company_name", "website_url", "industry")


_ordered = ("company_id, url, page_type, is_external, epoch(crawled_at)::BIGINT AS crawled, CASE WHEN is_external THEN 1 ELSE "
            "0 END AS new, page_id")


@query("page_upsert", f"""WITH p AS (SELECT {_ordered} FROM v_pages)
SELECT company_id, url, arg_max(CASE WHEN page_type = 'news' THEN 'other' ELSE page_type END, (new, page_id)) AS page_type,
  arg_max(is_external, (new, page_id)) AS is_external, arg_min(crawled, (new, page_id)) AS crawled FROM p GROUP BY 1, 2""")
def page_upsert(t):
    # External pages arrive after the stored ones; "news" is renamed to a type nobody knows.
    df = t.v_pages.withColumn("seq", F.struct(F.col("is_external").cast("int"), "page_id")).withColumn(
        "page_type", F.when(F.col("page_type") == "news", "bulletin").otherwise(F.col("page_type")))
    df = df.select("company_id", "url", "page_type", "is_external", "crawled_at", "seq")
    out = B.page_upsert(df.filter("NOT is_external"), df.filter("is_external"), ["page_type", "is_external"])
    return out.select("company_id", "url", "page_type", "is_external", F.unix_seconds("crawled_at").alias("crawled"))


@query("page_table_merge", f"""WITH p AS (SELECT {_ordered} FROM v_pages)
SELECT company_id, url, arg_max(CASE WHEN page_type = 'news' THEN 'other' ELSE page_type END, (new, page_id)) AS page_type,
  arg_max(is_external, (new, page_id)) AS is_external, arg_min(crawled, (new, page_id)) AS crawled FROM p GROUP BY 1, 2""")
def page_table_merge(t):
    """A stored table of pages: first the own pages of all companies, then the external ones, merged by parts."""
    df = t.v_pages.withColumn("seq", F.col("is_external").cast("long") * (1 << 60) + F.col("page_id")).withColumn(
        "page_type", F.when(F.col("page_type") == "news", "bulletin").otherwise(F.col("page_type")))  # a type nobody knows
    path = _out(t, "page-table")
    for part in ("NOT is_external", "is_external"):
        B.merge_pages(t.spark, path, df.filter(part), ["page_type", "is_external"])
    return t.spark.read.parquet(path).select(
        "company_id", "url", "page_type", "is_external", F.unix_seconds("crawled_at").alias("crawled"))


# Of each list of an entity the number of values, and all of them in one number, whatever their order.
_digests = ", ".join(f"count(*) FILTER (list = '{k}') AS n_{k}, coalesce(bit_xor(h) FILTER (list = '{k}'), 0) AS {k}" for k in B.LISTS)
_values = " UNION ALL ".join(f"SELECT company_id, type, cluster, '{k}' AS list, {c} AS value FROM al" for k, c in (
    B.LISTS | {"all_sources": "nullif(source_url, '')", "contexts": "nullif(context, '')"}).items())


@query("entity_sink", f"""WITH RECURSIVE {whole_sql}, canon AS (SELECT company_id, type, cluster, first(value ORDER BY o1, pos)
  AS v, min(nullif(context, '')) AS context_snippet, first(relationship ORDER BY o1, pos) FILTER (WHERE relationship IS NOT NULL)
  AS relationship FROM al GROUP BY 1, 2, 3),
vs AS (SELECT DISTINCT *, CAST('0x' || substr(md5(value), 1, 15) AS BIGINT) AS h FROM ({_values}) x WHERE value IS NOT NULL),
ds AS (SELECT company_id, type, cluster, {_digests} FROM vs GROUP BY 1, 2, 3)
SELECT company_id, type AS entity_type, best.v AS entity_value, mg.source_url, mentions, CASE WHEN type IN ('email', 'phone')
  THEN cluster ELSE canon.v END AS canonical, context_snippet, round(least(1.0, coalesce(best.c, 0.5) + least(0.2, mentions *
  0.02)), 6)::DOUBLE AS confidence, role, relationship, {', '.join(f"coalesce(ds.n_{k}, 0) AS n_{k}, coalesce(ds.{k}, 0) AS {k}" for k in B.LISTS)}
FROM mg JOIN canon USING (company_id, type, cluster) LEFT JOIN ds USING (company_id, type, cluster)""")
def entity_sink(t):
    """The merged entities of all types with all their sources, stored and read back."""
    whole = cut_lineage(D.cluster_all(t.v_mentions))
    canonical = whole.groupBy("company_id", "type", "cluster").agg(F.min("canonical").alias("canonical"))
    path = _out(t, "entities")
    rows = B.entity_rows(whole, D.merge(whole), canonical, D.EXTRA_KEYS)
    B.write_entities(rows, path)
    hashed = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")
    every = lambda k: F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(hashed(x)))
    lists = [x for k in B.LISTS for x in (F.sum(F.size(k)).alias(f"n_{k}"), F.bit_xor(every(k)).alias(k))]
    one = F.struct("entity_value", "source_url", "context_snippet", "confidence_score", "extra_data")
    df = t.spark.read.schema(rows.schema).parquet(path).groupBy("company_id", "entity_type", "cluster").agg(F.min_by(one, "piece").alias("e"), *lists)
    extra = lambda k: F.col("e.extra_data")[k]
    return df.select("company_id", "entity_type", "e.entity_value", "e.source_url", extra("mentions").cast("bigint").alias("mentions"),
                     extra("canonical").alias("canonical"), "e.context_snippet", F.round("e.confidence_score", 6).alias("confidence"),
                     extra("role").alias("role"), extra("relationship").alias("relationship"), *[x for k in B.LISTS for x in (f"n_{k}", k)])


def _core(t):
    companies = t.v_companies.withColumn("analysis_mode", F.when(F.col("seq") % 2 == 0, "quick").otherwise("thorough"))
    return B.brief_core(companies, t.v_analyses, t.v_usages)


_core_sql = """la AS (SELECT company_id, max(version) AS version FROM v_analyses GROUP BY 1),
us AS (SELECT company_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM v_usages
  GROUP BY 1),
core AS (SELECT c.*, CASE WHEN seq % 2 = 0 THEN 'quick' ELSE 'thorough' END AS mode, a.version, a.analysis_id, a.created_at AS
  analysed_at, a.executive_summary, a.full_analysis, coalesce(i, 0) AS i, coalesce(o, 0) AS o, round(coalesce(i, 0) *
  0.000003::DOUBLE + coalesce(o, 0) * 0.000015::DOUBLE, 4) AS rcost FROM v_companies c LEFT JOIN la USING (company_id)
  LEFT JOIN v_analyses a ON a.version = la.version AND a.company_id = la.company_id LEFT JOIN us ON us.company_id =
  c.company_id)"""
_doc_schema = (
    "company struct<id:string,name:string,websiteUrl:string,industry:string>, analysis struct<versionNumber:bigint,"
    "createdAt:string,executiveSummary:string,sections:map<string,struct<content:string,sources:array<string>,"
    "confidence:double>>>, tokenUsage struct<total:bigint,input:bigint,output:bigint,estimatedCost:double>, "
    "metadata struct<analysisMode:string>"
)


@query("brief_json_sink", f"""WITH {_core_sql}, {sections_sql}, ov AS (SELECT * FROM sections WHERE section = 'companyOverview'),
ne AS (SELECT company_id, count(*) AS n, md5(string_agg(entity_type || entity_value || coalesce(role, '') || source_url, ',' ORDER BY entity_id)) AS h
  FROM v_entities GROUP BY 1),
pz AS (SELECT company_id, count(*) AS n, md5(string_agg(url || page_type || is_external, ',' ORDER BY page_id)) AS h FROM v_pages GROUP BY 1)
SELECT core.company_id, company_name, industry, coalesce(version, 0) AS version, strftime(analysed_at, '%Y-%m-%dT%H:%M:%S') AS
  created_at, executive_summary, coalesce(ov.content, '') AS overview, coalesce(ov.sources, '') AS overview_sources,
  7::BIGINT AS n_sections, i + o AS total_tokens, rcost AS cost, mode, coalesce(ne.n, 0) AS n_entities,
  coalesce(ne.h, md5('')) AS entities_md5, coalesce(pz.n, 0) AS n_pages, coalesce(pz.h, md5('')) AS pages_md5
FROM core LEFT JOIN ov USING (analysis_id) LEFT JOIN ne ON ne.company_id = core.company_id LEFT JOIN pz ON pz.company_id = core.company_id""")
def brief_json_sink(t):
    path = _out(t, "briefs")
    docs = stored(B.brief_json(_core(t), F.lit("2024-03-01 12:00:00").cast("timestamp")), _out(t, "brief-docs"))
    B.write_json_export(docs, path, t.v_entities, t.v_pages, compression="gzip")
    df = B.read_json_export(
        t.spark, path, lambda e: F.concat(e["type"], e["value"], F.coalesce(e["extraData"]["role"], F.lit("")), e["sourceUrl"]),
        lambda p: F.concat(p["url"], p["pageType"], p["isExternal"].cast("string")))
    df = df.withColumn("d", F.from_json("doc", _doc_schema)).select("d.*", "n_entities", "entities_md5", "n_pages", "pages_md5")
    ov = F.col("analysis.sections")["companyOverview"]
    return df.select(
        F.col("company.id").alias("company_id"), F.col("company.name").alias("company_name"), "company.industry",
        F.col("analysis.versionNumber").alias("version"), F.col("analysis.createdAt").alias("created_at"),
        F.col("analysis.executiveSummary").alias("executive_summary"), ov["content"].alias("overview"),
        F.array_join(ov["sources"], " ").alias("overview_sources"),
        F.size("analysis.sections").cast("bigint").alias("n_sections"), F.col("tokenUsage.total").alias("total_tokens"),
        F.col("tokenUsage.estimatedCost").alias("cost"), F.col("metadata.analysisMode").alias("mode"),
        "n_entities", "entities_md5", "n_pages", "pages_md5")


def _sec(key, default):
    p = f"json_type(full_analysis, '$.{key}')"
    inner = f"json_extract_string(full_analysis, '$.{key}.content')"
    return (f"coalesce(CASE WHEN {p} = 'OBJECT' THEN {inner} ELSE nullif(json_extract_string(full_analysis, '$.{key}'), '') "
            f"END, {O.lit(default)})")


_nl, _rule = "chr(10)", "chr(10) || '---' || chr(10)"
_team = _sec("teamLeadership", "")
_doc = f""" || {_nl} || """.join([
    f"'# ' || company_name || ' - Intelligence Brief' || {_nl}",
    "'**Analysis Date:** ' || coalesce(strftime(analysed_at, '%Y-%m-%d %H:%M UTC'), 'Unknown')",
    "'**Website:** ' || website_url", "'**Industry:** ' || coalesce(nullif(industry, ''), 'Not specified')",
    "'**Analysis Mode:** ' || mode", "'**Pages Analyzed:** ' || coalesce(n_pages, 0)",
    "'**Tokens Used:** ' || format('{:,}', i + o) || ' (Est. Cost: $' || format('{:.4f}', rcost) || ')'", _rule,
    f"'## Executive Summary' || {_nl}", "coalesce(nullif(executive_summary, ''), '*No executive summary available.*')", _rule,
    f"'## Company Overview' || {_nl}", _sec("companyOverview", "*No company overview available.*"), _rule,
    f"'## Business Model & Products' || {_nl}", _sec("businessModel", "*No business model information available.*"), _rule,
    f"'## Team & Leadership' || {_nl} || coalesce({_nl} || '### Key Executives' || {_nl} || {_nl} || '| Name | Role |' || {_nl} "
    f"|| '|------|------|' || {_nl} || execs || {_nl}, '') || CASE WHEN {_team} <> '' THEN {_nl} || {_team} WHEN execs IS NULL "
    f"THEN {_nl} || '*No team information available.*' ELSE '' END", _rule,
    f"'## Market Position' || {_nl}", _sec("marketPosition", "*No market position information available.*"), _rule,
    f"'## Key Insights' || {_nl}", _sec("keyInsights", "*No key insights available.*"), _rule,
    f"'## Red Flags & Concerns' || {_nl}", _sec("redFlags", "No significant concerns identified."), _rule,
    f"'## Sources' || {_nl}", f"'Key pages analyzed:' || coalesce({_nl} || sources, '')", _rule,
    f"'*Generated by sitebrief v{B.VERSION}*'"])


@query("brief_markdown_sink", f"""WITH {_core_sql},
ke AS (SELECT company_id, string_agg('| ' || entity_value || ' | ' || role || ' |', chr(10) ORDER BY rn) AS execs FROM (SELECT *,
  row_number() OVER (PARTITION BY company_id ORDER BY entity_id) AS rn FROM v_entities WHERE entity_type = 'person' AND
  role <> '') x WHERE rn <= 10 GROUP BY 1),
kp AS (SELECT company_id, string_agg('- ' || url, chr(10) ORDER BY rn) AS sources FROM (SELECT *, row_number() OVER (PARTITION
  BY company_id ORDER BY CASE page_type WHEN 'about' THEN 1 WHEN 'team' THEN 2 WHEN 'product' THEN 3 WHEN 'service' THEN 4
  WHEN 'contact' THEN 5 ELSE 100 END, page_id) AS rn FROM v_pages) x WHERE rn <= 10 GROUP BY 1),
np AS (SELECT company_id, count(*) AS n_pages FROM v_pages GROUP BY 1)
SELECT core.company_id, {_doc} AS doc FROM core LEFT JOIN ke ON ke.company_id = core.company_id LEFT JOIN kp ON
  kp.company_id = core.company_id LEFT JOIN np ON np.company_id = core.company_id""")
def brief_markdown_sink(t):
    path = _out(t, "markdown")
    B.brief_markdown(_core(t), t.v_entities, t.v_pages, executives=10, sources=10).write.parquet(path)
    return t.spark.read.parquet(path)
