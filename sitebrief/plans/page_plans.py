"""Page, text and classification projections, and the site profile."""

from pyspark.sql import functions as F

from sitebrief.functions import classify as C
from sitebrief.functions import patterns as P
from sitebrief.functions import text as X
from sitebrief.functions import urls as U
from sitebrief.functions.extract import explode_rows, snippets
from sitebrief.operators import pages as pages_op
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.registry import query
from sitebrief.plans.url_plans import crawl_form_sql, external_sql



# The check decodes the references that the given pages hold, by its own list. Where a tag ends depends on quotes behind
# "=" in it; blocks without tags inside are marked first, then tags, by the leftmost match of one pattern each.
_REFERENCES = [("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
_REST = "(?:=\\s*\"[^\"]*\"|=\\s*''[^'']*''|[^>\"'']|[\"''])*?>"
_HIDDEN_SQL = ("'(?is)<!--.*?-->|" + "|".join(f"<{n}(?:\\s{_REST}|>).*?</{n}\\s*>" for n in ("script", "style", "noscript")) + "'")
_SHOWN_SQL = "'(?is)<textarea>([^<]*)<([^<]*)</textarea>'"
_TAGS_SQL = f"'(?is)</?[a-z][^\\s/>]*(?:[\\s/]{_REST}|>)|<[!?][^>]*>'"
_ATTR = "(?:\\s+[^\\s=>/]+(?:\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+))?)*?"
_HREF_SQL = f"'(?is)<a{_ATTR}\\s+href\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+)'"


def unescape_sql(x):
    for name, char in _REFERENCES:
        x = f"replace({x}, {O.lit(name)}, {O.lit(char)})"
    return x


title_sql = O.strip(unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def page_text_of(html):
    shown = f"regexp_replace({html}, {_SHOWN_SQL}, chr(1) || '\\1&lt;\\2' || chr(1), 'g')"
    shown = f"regexp_replace({shown}, {_HIDDEN_SQL}, chr(1), 'g')"
    nodes = f"string_split(regexp_replace({shown}, {_TAGS_SQL}, chr(1), 'g'), chr(1))"
    return (f"array_to_string(list_filter(list_transform({nodes}, lambda n: {O.strip(unescape_sql('n'))}), "
            f"lambda n: n <> ''), ' ')")


page_text_sql = page_text_of("html")


@query("page_title", f"SELECT page_id, {title_sql} AS title FROM v_markup")
def page_title(t):
    return t.v_markup.select("page_id", X.title(F.col("html")).alias("title"))


@query("page_text", f"SELECT page_id, {page_text_sql} AS text FROM v_markup")
def page_text(t):
    return t.v_markup.select("page_id", X.visible_text(F.col("html")).alias("text"))


_hrefs = (
    f"regexp_extract_all(regexp_replace(html, {_HIDDEN_SQL}, '', 'g'), {_HREF_SQL}, 1)"
)


ORACLE_LINKS = f"""h AS (SELECT page_id, url AS base, {_hrefs} AS hs FROM v_markup),
u AS (SELECT page_id, base, CAST(i - 1 AS BIGINT) AS pos,
  {unescape_sql("regexp_replace(hs[i], '^[\"'']|[\"'']$', '', 'g')")} AS href
  FROM (SELECT page_id, base, hs, unnest(range(1, len(hs) + 1)) AS i FROM h)),
r AS (SELECT *, CASE WHEN starts_with(href, '//') THEN {O.scheme('base')} || ':' || href
  WHEN starts_with(href, '/') THEN {O.scheme('base')} || '://' || {O.netloc('base')} || href ELSE href END AS f FROM u
  WHERE NOT regexp_matches(href, '^(javascript:|mailto:|tel:|#|data:)')),
lnk AS (SELECT page_id, pos, {crawl_form_sql('f')} AS link FROM r WHERE {crawl_form_sql('f')} IS NOT NULL)"""


@query("page_links", f"WITH {ORACLE_LINKS} SELECT page_id, pos, link FROM lnk")
def page_links(t):
    return pages_op.links(t.v_markup)


@query("page_hrefs", f"""WITH h AS (SELECT page_id, url AS base,
  regexp_extract_all(html, {O.lit(X._ANY_HREF)}, 1) AS hs FROM pages),
u AS (SELECT page_id, base, CAST(i - 1 AS BIGINT) AS pos, hs[i] AS href
  FROM (SELECT page_id, base, hs, unnest(range(1, len(hs) + 1)) AS i FROM h)),
e AS (SELECT page_id, pos, {external_sql('base', 'href')} AS link FROM u)
SELECT page_id, link, min(pos) AS pos FROM e WHERE link IS NOT NULL GROUP BY page_id, link""")
def page_hrefs(t):
    return pages_op.hrefs(t.pages)


@query("content_hash", f"SELECT doc_id, {O.content_hash('text')} AS content_hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("raw_hash", "SELECT page_id, sha256(html) AS raw_hash FROM pages")
def raw_hash(t):
    return t.pages.select("page_id", X.raw_hash(F.col("html")).alias("raw_hash"))


# Control characters are planted: the driver's texts have none.
_dirty = "'  ' || text || chr(7) || 'a' || chr(9) || chr(28) || 'b' || chr(160) || chr(10)"


@query("text_clean", f"""SELECT doc_id, {O.strip(
    "regexp_replace(" + O.collapse(_dirty) + ", '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")} AS cleaned
FROM documents""")
def text_clean(t):
    dirty = F.concat(F.lit("  "), "text", F.lit("\x07a\t\x1cb\xa0\n"))
    return t.documents.select("doc_id", X.clean(dirty).alias("cleaned"))


@query("text_is_meaningful", """SELECT doc_id,
  len(regexp_extract_all(text, '[a-zA-Z]{3,}')) >= 20 AS is_meaningful FROM documents""")
def text_is_meaningful(t):
    return t.documents.select("doc_id", X.is_meaningful(F.col("text")).alias("is_meaningful"))


@query("context_snippet", f"""WITH f AS (SELECT page_id, text, regexp_extract_all(text, '[A-Za-z]+ing') AS found,
    string_split_regex(text, '[A-Za-z]+ing') AS gaps FROM v_texts),
g AS (SELECT page_id, text, i, found[i] AS word, length(array_to_string(gaps[1:i], '')) + length(array_to_string(found[1:i - 1], ''))
    AS s FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM f)),
m AS (SELECT page_id, text, s, s + length(word) AS e FROM g),
a AS (SELECT *, greatest(s - 50, 0) AS l0, least(e + 50, length(text)) AS r0 FROM m),
b AS (SELECT *, l0 - length(regexp_extract(substr(text, 1, l0), '[^ \\n\\t]*$')) AS l,
  r0 + length(regexp_extract(substr(text, r0 + 1), '^[^ \\n\\t]*')) AS r FROM a)
SELECT page_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos,
  {O.strip("CASE WHEN l > 0 THEN '...' ELSE '' END || substr(text, l + 1, r - l) || "
           "CASE WHEN r < length(text) THEN '...' ELSE '' END")} AS snippet FROM b""")
def context_snippet(t):
    rows = explode_rows(t.v_texts, snippets("[A-Za-z]+ing")(F.col("text")), ["page_id"])
    return rows.select("page_id", F.col("_col.s").alias("start_pos"), F.col("_col.e").alias("end_pos"),
                       F.col("_col.context").alias("snippet"))


@query("html_escape_col", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), "
       "'>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages")
def html_escape_col(t):
    return t.pages.select("page_id", X.html_escape(F.col("html")).alias("escaped"))


_name = ("CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '../a\\b/' || doc_id || '.pdf' WHEN 2 THEN text || '.mark down' "
         "WHEN 3 THEN replace(text, '.', '') WHEN 4 THEN ' ' ELSE 'Report \"' || doc_id || '\" ' || chr(39) || 'x' "
         "|| chr(10) END")
_cut = f"regexp_replace(regexp_replace(name, '[/\\\\]', '_', 'g'), '[\\x00-\\x1f\\x7f\"'']', '', 'g')"


@query("safe_name", f"""WITH n AS (SELECT doc_id, {_name} AS name FROM documents),
c AS (SELECT doc_id, name, {_cut} AS n FROM n),
s AS (SELECT doc_id, name, CASE WHEN length(n) <= 200 THEN n WHEN contains(n, '.')
  THEN substr(regexp_extract(n, '(?s)^(.*)\\.([^.]*)$', 1), 1, 195) || '.' ||
       substr(regexp_extract(n, '(?s)^(.*)\\.([^.]*)$', 2), 1, 4)
  ELSE substr(n, 1, 200) END AS n FROM c)
SELECT doc_id, CASE WHEN trim(n) = '' THEN 'download' ELSE n END AS safe_name,
  substr(replace(replace(replace(name, ' ', '_'), '/', '_'), '\\', '_'), 1, 50) AS export_name FROM s""")
def safe_name(t):
    i = F.col("doc_id") % 6
    name = (
        F.when(i == 0, "").when(i == 1, F.concat(F.lit("../a\\b/"), "doc_id", F.lit(".pdf")))
        .when(i == 2, F.concat("text", F.lit(".mark down"))).when(i == 3, F.replace("text", F.lit("."), F.lit("")))
        .when(i == 4, " ").otherwise(F.concat(F.lit('Report "'), "doc_id", F.lit("\" 'x\n")))
    )
    return t.documents.select("doc_id", X.safe_name(name).alias("safe_name"), X.export_name(name, 50).alias("export_name"))


@query("page_scan", "SELECT doc_id AS page_id, source AS company_id, text FROM documents "
       "WHERE source = 'src3' AND text IS NOT NULL AND text <> ''")
def page_scan(t):
    return pages_op.with_text(
        t.documents.select(F.col("doc_id").alias("page_id"), F.col("source").alias("company_id"), "text"), "src3")


# --- classification ---------------------------------------------------------------------------

_lpath = f"lower({O.path('url')})"
first_type_sql = "CASE " + " ".join(
    f"WHEN regexp_matches(p, {O.lit('|'.join('(?:' + x + ')' for x in pats))}) THEN '{t}'"
    for t, pats in P.PATH_PATTERNS.items()) + " ELSE 'other' END"
priority_sql = "CASE page_type " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(P.PAGE_TYPES)) + (
    " ELSE 10 END")


@query("page_type_first_match", f"WITH a AS (SELECT page_id, url, {_lpath} AS p FROM v_site_texts) "
       f"SELECT page_id, url, {first_type_sql} AS page_type FROM a")
def page_type_first_match(t):
    return t.v_site_texts.select("page_id", "url", C.page_type_first_match(F.col("url")).alias("page_type"))


@query("page_priority", f"WITH a AS (SELECT page_id, {_lpath} AS p FROM v_site_texts), "
       f"b AS (SELECT page_id, {first_type_sql} AS page_type FROM a) "
       f"SELECT page_id, page_type, CAST({priority_sql} AS BIGINT) AS priority FROM b")
def page_priority(t):
    df = t.v_site_texts.select("page_id", C.page_type_first_match(F.col("url")).alias("page_type"))
    return df.withColumn("priority", C.page_priority(F.col("page_type")))


_url_rules = ", ".join(
    f"({i}, '{t}', {O.lit(p)}, {w}::DOUBLE)" for i, (t, p, w) in enumerate(C._URL_RULES))
_url_score = f"""rules(i, t, p, w) AS (VALUES {_url_rules}),
src AS (SELECT page_id, url, {_lpath} AS path FROM v_site_texts),
hits AS (SELECT page_id, i, t, w, p FROM src JOIN rules ON regexp_matches(path, '(?i)' || p)),
best AS (SELECT page_id, arg_max(t, w * 1000 - i) AS url_type, max(w) AS url_confidence,
  string_agg(p, ' ' ORDER BY i) AS url_matched FROM hits GROUP BY page_id)"""


@query("page_type_url_score", f"WITH {_url_score} SELECT s.page_id, url, url_type, url_confidence, "
       "coalesce(url_matched, '') AS url_matched FROM src s LEFT JOIN best USING (page_id)")
def page_type_url_score(t):
    df = C.with_url_score(t.v_site_texts.select("page_id", "url"))
    return df.withColumn("url_matched", F.array_join("url_matched", " "))


_content_rules = ", ".join(
    f"({o}, '{t}', {O.lit(p.replace(chr(92) + 's', WS_))}, {w}::DOUBLE)"
    for WS_ in [U.WS] for o, t in enumerate(P.PAGE_TYPES[:-1]) for p, w in P.CONTENT_WEIGHTS[t])
_counts = ", ".join(
    f"len(regexp_extract_all(x, {O.lit('(?i)' + p.replace(chr(92) + 's', U.WS))})) AS n{i}"
    for i, (t, p, w) in enumerate((t, p, w) for t in P.PAGE_TYPES[:-1] for p, w in P.CONTENT_WEIGHTS[t]))
_flat = [(t, w) for t in P.PAGE_TYPES[:-1] for _, w in P.CONTENT_WEIGHTS[t]]
_score_cols = ", ".join(
    "least((0.0::DOUBLE + " + " + ".join(
        f"least(n{i} * {w}::DOUBLE * 0.3::DOUBLE, {w}::DOUBLE)" for i, (tt, w) in enumerate(_flat) if tt == t)
    + f") / 2.0::DOUBLE, 1.0::DOUBLE) AS s_{t}" for t in P.PAGE_TYPES[:-1])
_top = "greatest(" + ", ".join(f"s_{t}" for t in P.PAGE_TYPES[:-1]) + ")"
_content_score = f"""ctext AS (SELECT page_id, {O.ascii_words('text')} AS x FROM v_site_texts),
counts AS (SELECT page_id, {_counts} FROM ctext),
sums AS (SELECT page_id, {_score_cols} FROM counts),
cbest AS (SELECT page_id, CASE WHEN {_top} > 0 THEN {_top} END AS content_confidence,
  CASE WHEN {_top} <= 0 THEN NULL {' '.join(f"WHEN s_{t} = {_top} THEN '{t}'" for t in P.PAGE_TYPES[:-1])} END
  AS content_type FROM sums)"""


@query("page_type_content_score", f"WITH {_content_score} SELECT page_id, content_type, "
       "round(content_confidence, 6) AS content_confidence FROM cbest")
def page_type_content_score(t):
    df = C.with_content_score(t.v_site_texts.select("page_id", "text"))
    return df.select("page_id", "content_type", F.round("content_confidence", 6).alias("content_confidence"))


@query("page_type_combined", f"""WITH {_url_score}, {_content_score},
j AS (SELECT s.page_id, url_type ut, url_confidence u, content_type ct, content_confidence c
  FROM src s LEFT JOIN best USING (page_id) LEFT JOIN cbest USING (page_id)),
k AS (SELECT page_id, ut, ct, u, c, CASE WHEN u IS NULL AND c IS NULL THEN 'default' WHEN c IS NULL THEN 'url'
  WHEN u IS NULL THEN 'content' WHEN ut = ct THEN 'combined' WHEN u >= c * 1.2 THEN 'url'
  WHEN c >= u * 1.2 THEN 'content' ELSE 'unsure' END AS s FROM j)
SELECT page_id, CASE s WHEN 'default' THEN 'other' WHEN 'content' THEN ct ELSE ut END AS page_type,
  round(CASE s WHEN 'default' THEN 0.5 WHEN 'content' THEN c WHEN 'combined' THEN least((u + c) / 1.5, 1.0)
    WHEN 'unsure' THEN u * 0.9 ELSE u END, 6)::DOUBLE AS confidence,
  CASE s WHEN 'unsure' THEN 'url' ELSE s END AS match_source FROM k""")
def page_type_combined(t):
    df = C.with_page_type(t.v_site_texts.select("page_id", "url", "text"))
    return df.select("page_id", "page_type", F.round("confidence", 6).alias("confidence"), "match_source")


def _handle(u):
    out = "CASE platform"
    for p, pats in P.PLATFORM_HANDLES.items():
        firsts = ", ".join(f"nullif(regexp_extract({u}, {O.lit('(?i)' + x)}, 1), '')" for x in pats)
        out += f" WHEN '{p}' THEN coalesce({firsts})"
    return out + " END"


_generic = ", ".join(O.lit(h) for h in P.GENERIC_HANDLES)
social_sql = f"""soc0 AS (SELECT *, {O.platform('url')} AS platform FROM v_social_urls),
soc1 AS (SELECT *, {_handle('url')} AS handle, CASE platform WHEN 'linkedin' THEN
    CASE WHEN contains(lower(url), '/company/') THEN 'company' WHEN contains(lower(url), '/in/') THEN 'person'
         WHEN contains(lower(url), '/showcase/') THEN 'page' ELSE 'unknown' END
    {' '.join(f"WHEN '{p}' THEN '{k}'" for p, k in P.PLATFORM_LINK_TYPE.items())} END AS link_type
  FROM soc0 WHERE platform IS NOT NULL),
soc AS (SELECT * FROM soc1 WHERE handle IS NULL OR lower(handle) NOT IN ({_generic}))"""


@query("social_link_detect", f"WITH {social_sql} SELECT link_id, url, platform, handle, link_type FROM soc")
def social_link_detect(t):
    return C.with_social_link(t.v_social_urls).select("link_id", "url", "platform", "handle", "link_type")


@query("social_platform", f"SELECT link_id, {O.platform('url')} AS platform, {O.platform('url')} IS NOT NULL AS "
       "is_social FROM v_social_urls")
def social_platform(t):
    p = C.social_platform(F.col("url"))
    return t.v_social_urls.select("link_id", p.alias("platform"), p.isNotNull().alias("is_social"))


@query("social_follow_filter", f"""SELECT link_id, url FROM v_social_urls WHERE CASE {O.platform('url')}
  WHEN 'linkedin' THEN follow_linkedin WHEN 'twitter' THEN follow_twitter WHEN 'facebook' THEN follow_facebook
  ELSE false END""")
def social_follow_filter(t):
    keep = C.may_follow(F.col("url"), F.col("follow_linkedin"), F.col("follow_twitter"), F.col("follow_facebook"))
    return t.v_social_urls.filter(keep).select("link_id", "url")


@query("social_company_filter", f"WITH {social_sql} SELECT link_id, url, link_type FROM soc "
       "WHERE link_type IN ('company', 'page', 'organization', 'channel')")
def social_company_filter(t):
    links = C.with_social_link(t.v_social_urls)
    return links.filter(F.col("link_type").isin(*P.COMPANY_LINK_TYPES)).select("link_id", "url", "link_type")


_site = "lower(regexp_extract(url, '//([^/?#]+)', 1))"


@query("site_profile", f"""WITH p AS (SELECT page_id, {_site} AS site, url, html, {page_text_sql} AS text,
  lower({O.path('url')}) AS p FROM pages),
h AS (SELECT page_id, site, {first_type_sql} AS page_type, {O.content_hash('text')} AS hash,
  len({_hrefs}) AS n_links FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY site, hash ORDER BY page_id) AS rn FROM h)
SELECT site, count(*) AS pages, count(*) FILTER (WHERE page_type <> 'other') AS typed_pages,
  count(*) FILTER (WHERE rn > 1) AS copies, CAST(sum(n_links) AS BIGINT) AS links FROM d GROUP BY site""")
def site_profile(t):
    return pages_op.site_profile(t.pages)
