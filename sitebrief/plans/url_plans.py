"""URL projections."""

from pyspark.sql import functions as F

from sitebrief.functions import urls as U
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.registry import query



def _q(u):
    return f"CASE WHEN {u} <> '' THEN '?' || {u} ELSE '' END"


_norm_u = f"({O.with_scheme(O.strip('url'))})"
_normalized = (
    f"{O.scheme('s')} || '://' || {O.netloc('s')} || CASE WHEN {O.path('s')} = '' THEN '/' ELSE {O.path('s')} END || "
    f"{_q(O.query('s'))}"
)


@query("url_normalize_input", f"WITH u AS (SELECT url_id, url, {_norm_u} AS s FROM v_urls) "
       f"SELECT url_id, url, {_normalized} AS normalized FROM u")
def url_normalize_input(t):
    return t.v_urls.select("url_id", "url", U.normalize_input(F.col("url")).alias("normalized"))


_tracking = ", ".join(O.lit(k) for k in U.TRACKING_KEYS)
_canon_tail = f"""
parts AS (SELECT url_id, i, string_split({O.query('url')}, '&')[i] AS p
          FROM (SELECT url_id, url, unnest(range(1, len(string_split({O.query('url')}, '&')) + 1)) AS i FROM src)),
kv AS (SELECT url_id, i, url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')) AS k,
              url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) AS v FROM parts WHERE p <> ''),
firsts AS (SELECT url_id, k, arg_min(v, i) AS v FROM kv WHERE lower(k) NOT IN ({_tracking}) GROUP BY url_id, k),
qs AS (SELECT url_id, string_agg(k || '=' || v, '&' ORDER BY k) AS q FROM firsts GROUP BY url_id)
"""
_canon_path = (
    f"CASE WHEN {O.path('url')} = '' OR {O.path('url')} = '/' THEN '/' ELSE rtrim({O.path('url')}, '/') END"
)
_canon = (
    f"CASE WHEN {O.scheme('url')} = '' THEN 'https' ELSE {O.scheme('url')} END || '://' || lower({O.netloc('url')}) || "
    f"{_canon_path} || CASE WHEN q IS NULL THEN '' ELSE '?' || q END"
)


@query("url_canonical", f"WITH src AS (SELECT url_id, url FROM v_urls), {_canon_tail} "
       f"SELECT url_id, url, {_canon} AS canonical FROM src LEFT JOIN qs USING (url_id)")
def url_canonical(t):
    return t.v_urls.select("url_id", "url", U.canonical(F.col("url")).alias("canonical"))


def crawl_form_sql(u):
    host = (f"CASE WHEN {O.scheme(u)} = 'http' THEN replace(lower({O.netloc(u)}), ':80', '') "
            f"ELSE replace(lower({O.netloc(u)}), ':443', '') END")
    pth = (f"CASE WHEN {O.path(u)} = '' THEN '/' WHEN length({O.path(u)}) > 1 THEN rtrim({O.path(u)}, '/') "
           f"ELSE {O.path(u)} END")
    return (f"CASE WHEN {O.scheme(u)} IN ('http', 'https') AND {O.netloc(u)} <> '' "
            f"THEN {O.scheme(u)} || '://' || {host} || {pth} END")


@query("url_crawl_form", f"SELECT url_id, url, {crawl_form_sql('url')} AS crawl_url FROM v_urls")
def url_crawl_form(t):
    return t.v_urls.select("url_id", "url", U.crawl_form(F.col("url")).alias("crawl_url"))


_base_dir = f"regexp_replace({O.path('base')}, '[^/]*$', '')"
_rel = f"({O.scheme('href')} = '' OR ({O.scheme('href')} = {O.scheme('base')} AND {O.netloc('href')} = ''))"
# Dot segments: collapse "x/.." pairs a fixed number of times, enough for these inputs.
_dots = "regexp_replace(p0, '/\\./', '/', 'g')"
_dots = f"regexp_replace({_dots}, '/\\.$', '/')"
for _ in range(4):
    _dots = f"regexp_replace({_dots}, '^((?:/[^/]+)*?)/[^/]+/\\.\\.(/|$)', '\\1/')"
for _ in range(2):
    _dots = f"regexp_replace({_dots}, '^/\\.\\.(/|$)', '/')"


@query("link_resolve", f"""WITH a AS (
  SELECT page_id, base, href, {_rel} AS rel,
    CASE WHEN {O.path('href')} = '' THEN {O.path('base')}
         WHEN starts_with({O.path('href')}, '/') THEN {O.path('href')}
         ELSE regexp_replace({_base_dir} || {O.path('href')}, '//+', '/', 'g') END AS p0
  FROM v_hrefs),
b AS (SELECT *, CASE WHEN NOT rel THEN href
      WHEN {O.netloc('href')} <> '' THEN {O.scheme('base')} || '://' || {O.netloc('href')} || {O.path('href')}
      ELSE {O.scheme('base')} || '://' || {O.netloc('base')} || {_dots} END AS full_url FROM a)
SELECT page_id, href, CASE WHEN href = '' OR starts_with(href, '#')
  OR regexp_matches(href, '^(javascript|mailto|tel|data):') THEN NULL ELSE {crawl_form_sql('full_url')} END AS link
FROM b""")
def link_resolve(t):
    return t.v_hrefs.select("page_id", "href", U.link_resolve(F.col("base"), F.col("href")).alias("link"))


def external_sql(base, href):
    full = (f"CASE WHEN starts_with({href}, '//') THEN 'https:' || {href} WHEN starts_with({href}, '/') "
            f"THEN {O.scheme(base)} || '://' || {O.netloc(base)} || {href} ELSE {href} END")
    return (f"CASE WHEN {href} = '' OR regexp_matches({href}, '^(javascript:|mailto:|tel:|#)') THEN NULL "
            f"WHEN {O.http('(' + full + ')')} THEN {full} END")


@query("external_url_form", f"SELECT page_id, href, {external_sql('base', 'href')} AS link FROM v_hrefs")
def external_url_form(t):
    return t.v_hrefs.select("page_id", "href", U.external_form(F.col("base"), F.col("href")).alias("link"))


@query("registry_key", "SELECT url_id, url, rtrim(url, '/') AS registry_key FROM v_urls")
def registry_key(t):
    return t.v_urls.select("url_id", "url", U.registry_key(F.col("url")).alias("registry_key"))


@query("url_domain", f"SELECT url_id, url, CASE WHEN {O.netloc('url')} = '' THEN url ELSE {O.netloc('url')} END AS "
       "domain FROM v_urls")
def url_domain(t):
    return t.v_urls.select("url_id", "url", U.domain(F.col("url")).alias("domain"))


_rp = f"CASE WHEN {O.path('url')} = '' THEN '/' ELSE {O.path('url')} END || {_q(O.query('url'))}"


@query("robots_path", f"SELECT url_id, url, CASE WHEN starts_with({_rp}, '/') THEN {_rp} ELSE '/' || {_rp} END AS "
       "robots_path FROM v_urls")
def robots_path(t):
    return t.v_urls.select("url_id", "url", U.robots_path(F.col("url")).alias("robots_path"))


@query("url_valid_format", f"""WITH u AS (SELECT url_id, url, {_norm_u} AS s FROM v_urls),
n AS (SELECT url_id, url, {_normalized} AS n FROM u),
h AS (SELECT *, string_split({O.netloc('n')}, ':')[1] AS host FROM n),
e AS (SELECT url_id, url, CASE WHEN url = '' THEN 'URL is required'
  WHEN NOT regexp_matches(n, {O.lit(U.SITE_URL)}) THEN 'Invalid URL format: ' || url
  WHEN host = '' OR starts_with(host, '.') OR ends_with(host, '.') THEN 'Invalid domain in URL'
  WHEN host <> 'localhost' AND NOT contains(host, '.') THEN 'Domain must include a TLD (e.g., .com, .org)' END AS error
  FROM h)
SELECT url_id, url, error IS NULL AS is_valid, error FROM e""")
def url_valid_format(t):
    e = U.format_error(F.col("url"))
    return t.v_urls.select("url_id", "url", e.isNull().alias("is_valid"), e.alias("error"))


@query("url_valid_batch", f"""SELECT url_id, url, CASE WHEN url = '' THEN 'URL is required'
  WHEN NOT regexp_matches({O.with_scheme('url')}, {O.lit(U.UPLOAD_URL)}) THEN 'Invalid URL format' END AS error
FROM v_urls""")
def url_valid_batch(t):
    return t.v_urls.select("url_id", "url", U.upload_error(F.col("url")).alias("error"))


@query("url_blocked_network", f"""SELECT url_id, url, CASE WHEN url = '' THEN 'URL is required'
  WHEN NOT {O.http('lower(url)')} THEN 'URL must start with http:// or https://'
  WHEN regexp_matches(lower(url), {O.lit(U.BLOCKED_NETWORK)}) THEN 'URL points to a blocked network address' END
  AS reason FROM v_urls""")
def url_blocked_network(t):
    return t.v_urls.select("url_id", "url", U.blocked_reason(F.col("url")).alias("reason"))


@query("url_is_pdf", """SELECT url_id, url, regexp_matches(lower(url), '\\.pdf$|format=pdf|type=pdf') AS is_pdf,
  starts_with(CASE WHEN url_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '' END || page_url, '%PDF') AS is_pdf_content
FROM v_urls""")
def url_is_pdf(t):
    body = F.concat(F.when(F.col("url_id") % 3 == 0, "%PDF-1.7 ").otherwise(""), "page_url").cast("binary")
    return t.v_urls.select("url_id", "url", U.is_pdf(F.col("url")).alias("is_pdf"), U.is_pdf_bytes(body).alias("is_pdf_content"))


@query("url_in_scope", f"""SELECT url_id, url FROM v_urls
WHERE lower({O.netloc('url')}) = lower({O.netloc('page_url')}) AND depth <= 2
  AND NOT regexp_matches(url, '(?i)UTM_|/private/')""")
def url_in_scope(t):
    ok = U.in_scope(F.col("url"), F.col("page_url"), F.col("depth"), 2, ["UTM_", "/private/"])
    return t.v_urls.filter(ok).select("url_id", "url")
