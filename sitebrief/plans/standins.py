"""Views that give the driver's tables the shape of crawl data.

Each is one SQL text that Spark and DuckDB both run (``TS_SEC(x)`` stands for "timestamp of
epoch second x"), so a plan and its check read the very same rows. Every view reads a driver
table and grows with it; planted phrases make rare patterns occur.
"""

STANDINS: dict[str, str] = {}

# URLs as users and pages write them: odd cases, ports, tracking keys, no scheme, no host.
STANDINS["v_urls"] = """
SELECT page_id AS url_id, CAST(page_id % 4 AS BIGINT) AS depth, url AS page_url,
  CASE page_id % 20
    WHEN 0 THEN url
    WHEN 1 THEN replace(url, 'example', 'EXAMPLE')
    WHEN 2 THEN replace(url, '.example.', '.example.com:80/a/about-us?x=.')
    WHEN 3 THEN replace(replace(url, '?page=2&ref=x', ''), '#top', '') || '/about-us/'
    WHEN 4 THEN 'www.site' || page_id || '.example.com'
    WHEN 5 THEN 'http://192.168.0.' || (page_id % 250) || '/admin?type=PDF'
    WHEN 6 THEN 'http://localhost:8080/files/report.pdf'
    WHEN 7 THEN 'https://shop.example.com/p/' || page_id || '/?b=2&a=1&a=3&UTM_Source=x&empty=&q=a%20b+c&%zz=1#frag'
    WHEN 8 THEN 'javascript:void(0)'
    WHEN 9 THEN 'https://no-tld' || page_id
    WHEN 10 THEN 'ftp://files.example.com/' || page_id
    WHEN 11 THEN ''
    WHEN 12 THEN '  https://spaced.example.com/team/  '
    WHEN 13 THEN 'https://example.com/products/item' || page_id || '/?format=pdf'
    WHEN 14 THEN 'HTTPS://Mixed.Example.COM/Careers/;v=1'
    WHEN 15 THEN '//cdn.example.com/news/' || page_id
    WHEN 16 THEN 'https://intranet.corp.local'
    WHEN 17 THEN url || '&utm_campaign=z&page=' || page_id
    WHEN 18 THEN 'https://example.com:443/services///?z=1&y=2&&=5&k'
    ELSE 'mailto:info@site' || page_id || '.example.com'
  END AS url
FROM pages"""

# References found on pages.
STANDINS["v_hrefs"] = """
SELECT page_id, url AS base,
  CASE page_id % 16
    WHEN 0 THEN '/products/' || page_id
    WHEN 1 THEN 'team.html?x=1'
    WHEN 2 THEN '../up/' || page_id
    WHEN 3 THEN './here/'
    WHEN 4 THEN '?page=3'
    WHEN 5 THEN '//other.example.com/a'
    WHEN 6 THEN 'HTTP://Other.Example.com:80/B/'
    WHEN 7 THEN 'mailto:a@b.example.com'
    WHEN 8 THEN '#part'
    WHEN 9 THEN '/a/../b/./c/..'
    WHEN 10 THEN 'https://www.linkedin.com/company/acme-' || page_id || '/'
    WHEN 11 THEN 'a//b/../' || page_id
    WHEN 12 THEN 'tel:+1415'
    WHEN 13 THEN ''
    WHEN 14 THEN '/../../x'
    ELSE 'ftp://h/x'
  END AS href
FROM pages"""

# Pages with the marks that patterns over tags get wrong: signs in quotes, text like tags, odd ends.
STANDINS["v_markup"] = """
SELECT page_id, url, replace(html, '</body>', CASE page_id % 8
    WHEN 0 THEN '<p title="a > b">q1</p><a data-x=' || chr(39) || '1>0' || chr(39) || ' HREF="/in?x=1>0">q2</a>'
    WHEN 1 THEN '<script>if (a<b && c>d) { t = "<p>no</p>"; }</script >q3<STYLE type="x>y">p>b{}</STYLE>'
    WHEN 2 THEN '<!-- <p>no</p> > --><p>1 < 2 and 3 > 2</p><a href=/plain>q4</a><a name="n">q5</a>'
    WHEN 3 THEN '<noscript><a href="/no">no</a><p>no</p></noscript ><img alt="x>y" src=/i.png/><br/>q6'
    WHEN 4 THEN '<div class="' || chr(39) || '>" id=' || chr(39) || '"' || chr(39) || '>q7</div><textarea>a <b> c</textarea>'
    WHEN 5 THEN '<a title="href=/no" href = "/yes" href="/no">q8</a><?php x ?>q9'
    ELSE '' END || '</body>') AS html
FROM pages"""

# Links to social platforms and elsewhere.
STANDINS["v_social_urls"] = """
SELECT c_custkey AS link_id, c_nationkey AS site_id,
  c_custkey % 3 <> 0 AS follow_linkedin, c_custkey % 2 = 0 AS follow_twitter, c_custkey % 5 = 0 AS follow_facebook,
  CASE c_custkey % 18
    WHEN 0 THEN 'https://www.linkedin.com/company/acme-' || c_custkey
    WHEN 1 THEN 'https://linkedin.com/in/jane_' || c_custkey || '?x=1'
    WHEN 2 THEN 'https://www.linkedin.com/showcase/Line-' || c_custkey || '/'
    WHEN 3 THEN 'https://www.linkedin.com/feed'
    WHEN 4 THEN 'https://twitter.com/Handle' || c_custkey
    WHEN 5 THEN 'https://X.com/intent/tweet'
    WHEN 6 THEN 'https://www.facebook.com/page.' || c_custkey || '?ref=1'
    WHEN 7 THEN 'http://fb.com/fb' || c_custkey || '/'
    WHEN 8 THEN 'https://www.instagram.com/in.sta_' || c_custkey || '/'
    WHEN 9 THEN 'https://www.youtube.com/@chan-' || c_custkey
    WHEN 10 THEN 'https://www.youtube.com/watch?v=1'
    WHEN 11 THEN 'https://github.com/org' || c_custkey || '/repo'
    WHEN 12 THEN 'https://github.com/About'
    WHEN 13 THEN 'https://notgithub.com/org'
    WHEN 14 THEN 'https://mobile.twitter.com/h'
    WHEN 15 THEN 'https://www.facebook.com/sharer/sharer.php'
    WHEN 16 THEN 'https://x.com/x' || c_custkey || '-y'
    ELSE 'https://site' || c_custkey || '.example.com/linkedin.com/company/no'
  END AS url
FROM customer"""

# Page texts: the documents, with a business phrase planted in each.
STANDINS["v_texts"] = """
SELECT doc_id AS page_id, source AS company_id, 'https://' || source || '.example.com/p/' || doc_id AS source_url,
  text || CASE doc_id % 24
    WHEN 0 THEN ' Our mission: read our story. Founded in 1990.'
    WHEN 1 THEN ' Meet our team; the leadership  team and the board of directors. Founders & CEO.'
    WHEN 2 THEN ' Our products and key features. Product overview.'
    WHEN 3 THEN ' Contact us or get in touch at sales' || doc_id || '@acme.io or SALES' || doc_id || '@acme.io today.'
    WHEN 4 THEN ' Write to jane.doe [at] acme' || doc_id || ' [dot] com, john(at)beta.org or joe at gamma dot net.'
    WHEN 5 THEN ' Call (415) 555-0' || (100 + doc_id % 900) || ', +1-415-555-2671 ext 22 or 415.555.2671.'
    WHEN 6 THEN ' Visit 12 Main Street, Suite 5, Springfield, IL 62701-1234. Or Denver Town, CO 80202.'
    WHEN 7 THEN ' Office at 10 Downing Road London, SW1 2AA. mail logo@pic.png and info@example.com.'
    WHEN 8 THEN ' Follow https://twitter.com/acme' || doc_id || ' and @acme_io, https://www.linkedin.com/company/acme/ '
    WHEN 9 THEN ' See https://github.com/acme/x https://facebook.com/share/1 www.instagram.com/acme?x youtube.com/c/acme/'
    WHEN 10 THEN ' We use Python, JavaScript, Java and java, Java Script, C++, C#, C++x, Git and GitHub Actions on AWS.'
    WHEN 11 THEN ' Stack: React.js, Node.js, PostgreSQL, MongoD, K8s, Docker, RESTful API, R programming, .NET, Go.'
    WHEN 12 THEN ' Job openings: we' || chr(39) || 're hiring! Join our team. Open positions, career opportunities.'
    WHEN 13 THEN ' Pricing plans: monthly plan, free trial, $5 per month. per month per month per month per month.'
    WHEN 14 THEN ' Latest posts. Blog post published on Monday. Press release. News & events. In the news.'
    WHEN 15 THEN ' Our services: what we offer. Contact us. Contact us. Contact us. Contact us. Request a demo.'
    ELSE ''
  END AS text
FROM documents"""

# Pages with URL, type and text: the same texts under business paths.
STANDINS["v_site_texts"] = """
SELECT page_id, company_id, text, 'https://' || company_id || '.example.com' || CASE page_id % 14
    WHEN 0 THEN '/about-us/' WHEN 1 THEN '/team/' WHEN 2 THEN '/products/x' || page_id WHEN 3 THEN '/contact'
    WHEN 4 THEN '/teammates' WHEN 5 THEN '/blog/' || page_id WHEN 6 THEN '/Careers' WHEN 7 THEN '/pricing'
    WHEN 8 THEN '/press-releases' WHEN 9 THEN '/services/' WHEN 10 THEN '/company/history' WHEN 11 THEN '/support'
    WHEN 12 THEN '/x/our-team/board' ELSE '/p/' || page_id END AS url
FROM v_texts"""

# Companies with status, phase, run times and totals.
STANDINS["v_companies"] = """
SELECT 'c' || c_custkey AS company_id, c_custkey AS seq, c_name AS company_name,
  'https://www.' || lower(replace(c_name, '#', '-')) || '.example.com' ||
    CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END AS website_url,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS industry,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'b' || c_nationkey END AS batch_id,
  CASE WHEN c_custkey * 7 % 10 < 4 THEN 'pending' WHEN c_custkey * 7 % 10 < 6 THEN 'in_progress'
    WHEN c_custkey * 7 % 10 < 8 THEN 'completed' WHEN c_custkey * 7 % 10 = 8 THEN 'failed' ELSE 'paused' END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'crawling' WHEN 2 THEN 'extracting' WHEN 3 THEN 'analyzing'
    WHEN 4 THEN 'generating' ELSE 'completed' END AS phase,
  CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS tokens, abs(c_acctbal) / 1000 AS cost,
  TS_SEC((1704067200 + c_custkey * 37 % 1000 * 3600)) AS created_at,
  CASE WHEN c_custkey * 7 % 10 < 4 THEN NULL ELSE TS_SEC((1704067200 + c_custkey * 37 % 1000 * 3600 + 600)) END
    AS started_at,
  CAST(c_custkey % 11 * 1700 AS BIGINT) AS paused_ms
FROM customer"""

# Batches of companies.
STANDINS["v_batches"] = """
SELECT 'b' || n_nationkey AS batch_id, n_name AS batch_name,
  CASE n_nationkey % 6 WHEN 0 THEN 'processing' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
    WHEN 3 THEN 'cancelled' WHEN 4 THEN 'paused' ELSE 'pending' END AS status,
  CAST(n_regionkey * 10 AS BIGINT) AS priority, CAST(floor((SELECT count(*) FROM customer) / 125) + 2 + n_nationkey % 4 AS BIGINT) AS max_concurrent,
  TS_SEC((1704067200 + n_nationkey % 5 * 86400)) AS created_at,
  CASE WHEN n_nationkey % 6 IN (2, 3) THEN TS_SEC((1704067200 + n_nationkey * 86400)) ELSE NULL END AS completed_at
FROM nation"""

# The companies as a scheduler meets them: few are in progress, however many wait.
STANDINS["v_queue"] = """
SELECT company_id, batch_id, created_at, CASE WHEN status = 'in_progress' AND seq > 40 THEN 'completed' ELSE status END AS status
FROM v_companies"""

# Model calls. A third of them belong to one company.
STANDINS["v_usages"] = """
SELECT conv_id * 1000 + turn AS usage_id, CASE WHEN conv_id % 3 = 0 THEN 'c0' ELSE 'c' || conv_id END AS company_id,
  CASE turn % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'Summarization' WHEN 2 THEN 'analysis' ELSE 'mystery' END
    AS call_type,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'company_overview' ELSE '' END AS section,
  CAST(length(text) AS BIGINT) AS input_tokens, CAST(length(replace(text, ' ', '')) AS BIGINT) AS output_tokens,
  TS_SEC((1704067200 + conv_id * 3600 + turn * 60)) AS ts
FROM conversations"""

# Crawl sessions with the checkpoint text each left behind.
STANDINS["v_sessions"] = """
SELECT o_orderkey AS session_id, 'c' || o_custkey AS company_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS pages_crawled, CAST(o_orderkey % 90 AS BIGINT) AS pages_queued,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'paused' END AS status,
  CASE o_orderkey % 9
    WHEN 0 THEN '{"version":1,"pagesVisited":["https://h/a","https://h/' || o_orderkey ||
      '"],"pagesQueued":["https://h/q"],"externalLinksFound":[],"currentDepth":2,"crawlStartTime":' ||
      '"2024-01-01T00:00:00Z","lastCheckpointTime":"2024-01-01T01:00:00Z","entitiesExtractedCount":' || o_orderkey ||
      ',"analysisSectionsCompleted":["company_overview"]}'
    WHEN 1 THEN '{"currentDepth":"3"}'
    WHEN 2 THEN '{"pagesVisited":["a"'
    WHEN 3 THEN '{"visited":["x"],"pagesQueued":["q' || o_custkey || '","q2"]}'
    WHEN 4 THEN '{"pagesVisited":"oops","entitiesExtractedCount":"7","externalLinksFound":["e"]}'
    WHEN 5 THEN '{}'
    WHEN 6 THEN '[1,2]'
    WHEN 7 THEN '{"entitiesExtractedCount":"x","currentDepth":2.7,"pagesVisited":["v' || o_orderkey || '"]}'
    ELSE NULL END AS checkpoint
FROM orders"""

# Report versions with their sections.
STANDINS["v_analyses"] = """
SELECT o_orderkey AS analysis_id, 'c' || o_custkey AS company_id, o_orderkey AS version,
  CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Summary of ' || o_orderkey END AS executive_summary,
  CAST(floor(o_totalprice / 10) AS BIGINT) AS total_input, CAST(floor(o_totalprice / 40) AS BIGINT) AS total_output,
  CASE o_orderkey % 4
    WHEN 0 THEN '{"companyOverview":{"content":"Overview ' || o_orderkey ||
      '","sources":["https://s/1","https://s/2"],"confidence":0.8},"businessModel":"plain ' || o_custkey ||
      '","redFlags":""}'
    WHEN 1 THEN '{"keyInsights":{"content":"Insight ' || o_orderkey || '"},"technology":{"confidence":0.5}}'
    WHEN 2 THEN '{"teamLeadership":{"content":"Team","sources":"none","confidence":"0.25"},"marketPosition":7}'
    ELSE NULL END AS full_analysis
FROM orders"""

# The same versions, most of them with a team (an object) and products (an array) among their sections.
STANDINS["v_versions"] = """
SELECT analysis_id, company_id, version, executive_summary, CASE WHEN version % 3 = 0 THEN full_analysis ELSE '{"team":' ||
    CASE version % 7 WHEN 0 THEN 'null' WHEN 1 THEN '{}' ELSE '{"ceo":"P' || (version % 3) || '","cto":' || CASE version % 4 WHEN 0
      THEN 'null' WHEN 1 THEN '{"name":"Q","since":2001}' ELSE '"R"' END || ',"size":' || (version % 5) || '}' END ||
    ',"products":' || CASE version % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["A","B","A"]' ELSE '["B","C' || (version % 3) || '",' ||
      (version % 2) || ',{"name":"D"}]' END ||
    CASE version % 4 WHEN 0 THEN '' WHEN 1 THEN ',"market":"wide"' WHEN 2 THEN ',"market":["wide"]' ELSE ',"market":7' END || '}' END
  AS full_analysis
FROM v_analyses"""

# Spans a model found, with the text around them.
STANDINS["v_spans"] = """
SELECT c_custkey AS span_id, 'c' || c_nationkey AS company_id,
  CASE c_custkey % 12 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' WHEN 3 THEN 'LAW' WHEN 4 THEN 'CARDINAL'
    WHEN 5 THEN 'MONEY' WHEN 6 THEN 'NORP' WHEN 7 THEN 'PERSON' WHEN 8 THEN 'EVENT' WHEN 9 THEN 'LANGUAGE'
    WHEN 10 THEN 'PRODUCT' ELSE 'ORG' END AS label,
  CASE c_custkey % 8 WHEN 0 THEN 'Jane Q. Public' WHEN 1 THEN 'ACME CORP' WHEN 2 THEN 'x' WHEN 3 THEN 'paris'
    WHEN 4 THEN 'One Two Three Four Five Six' WHEN 5 THEN 'IBM' WHEN 6 THEN '  ' ELSE c_name END AS value,
  CASE c_custkey % 15 WHEN 0 THEN 'our CEO and Founder' WHEN 1 THEN 'she will lead the team' WHEN 2 THEN
    'Vice President of Sales' WHEN 3 THEN 'a Director of Ops, partnered' WHEN 4 THEN 'we serve them' WHEN 5 THEN
    'backed by funding' WHEN 6 THEN 'versus a competitor' WHEN 7 THEN 'a merger was planned' WHEN 8 THEN
    'software engineer' WHEN 9 THEN 'Head of' WHEN 10 THEN 'chairman and designer' WHEN 11 THEN 'the SVP'
    WHEN 12 THEN 'Chief Legal Officer' WHEN 13 THEN 'nothing here' ELSE 'client ' || c_name END AS context
FROM customer"""

# Model answers with and without source lists.
STANDINS["v_answers"] = """
SELECT conv_id * 1000 + turn AS answer_id, 'c' || conv_id AS company_id, role, turn,
  text || CASE turn % 4 WHEN 0 THEN ' SOURCES: https://a.example.com/' || conv_id || ' (https://b.example.com/x>) [https://c.example.com]'
    WHEN 1 THEN ' Sources: https://no.example.com' WHEN 2 THEN ' SOURCES: none. SOURCES: http://late.example.com' ||
      ' https://1 https://2 https://3 https://4 https://5 https://6 https://7 https://8 https://9 https://10 https://11'
    ELSE '' END AS answer
FROM conversations"""

# Sitemap dates in several spellings.
STANDINS["v_lastmods"] = """
SELECT o_orderkey AS entry_id, CASE o_orderkey % 11
    WHEN 0 THEN d WHEN 1 THEN d || 'T10:11:12Z' WHEN 2 THEN d || 'T10:11:12+00:00' WHEN 3 THEN d || 'T10:11:12+0200'
    WHEN 4 THEN d || 'T10:11:12-05:30' WHEN 5 THEN d || ' 10:11:12' WHEN 6 THEN 'last ' || d
    WHEN 7 THEN d || 'T10:11:12.500Z' WHEN 8 THEN '2024-13-45' WHEN 9 THEN '' ELSE d || 'T10:11:12' END AS lastmod
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) x"""

# Stored entities. One company holds a third of them.
STANDINS["v_entities"] = """
SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS entity_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 'c0' ELSE 'c' || l_suppkey END AS company_id,
  CASE l_partkey % 12 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'location' WHEN 3 THEN 'product'
    WHEN 4 THEN 'date' WHEN 5 THEN 'money' WHEN 6 THEN 'email' WHEN 7 THEN 'phone' WHEN 8 THEN 'address'
    WHEN 9 THEN 'social_handle' WHEN 10 THEN 'tech_stack' ELSE 'person' END AS entity_type,
  'Entity ' || l_partkey AS entity_value, 0.5 + l_discount * 4 AS confidence,
  'https://p.example.com/' || l_orderkey % 500 AS source_url,
  CASE WHEN l_partkey % 12 IN (0, 11) AND l_linenumber % 2 = 0 THEN 'Role ' || l_quantity ELSE NULL END AS role,
  CASE WHEN l_partkey % 12 = 1 AND l_linenumber % 2 = 1 THEN 'partner' ELSE NULL END AS relationship
FROM lineitem"""

# Stored pages per company.
STANDINS["v_pages"] = """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN 'c0' ELSE 'c' || o_custkey END AS company_id,
  'https://www.example.com/p/' || o_orderkey % 5000 AS url,
  CASE o_orderkey * 7 % 10 WHEN 0 THEN 'about' WHEN 1 THEN 'team' WHEN 2 THEN 'product' WHEN 3 THEN 'service'
    WHEN 4 THEN 'contact' WHEN 5 THEN 'careers' WHEN 6 THEN 'pricing' WHEN 7 THEN 'blog' WHEN 8 THEN 'news'
    ELSE 'other' END AS page_type,
  CAST(o_orderdate AS TIMESTAMP) AS crawled_at, o_orderstatus = 'P' AS is_external
FROM orders"""

# Section results of report runs.
STANDINS["v_section_results"] = """
SELECT l_orderkey AS analysis_id, CAST(l_linenumber % 8 AS BIGINT) AS ord,
  CASE l_linenumber % 8 WHEN 0 THEN 'executive_summary' WHEN 1 THEN 'company_overview' WHEN 2 THEN 'business_model'
    WHEN 3 THEN 'team_leadership' WHEN 4 THEN 'market_position' WHEN 5 THEN 'technology' WHEN 6 THEN 'key_insights'
    ELSE 'red_flags' END AS section,
  max(CASE WHEN l_returnflag = 'R' THEN '' ELSE 'Text ' || l_partkey END) AS content,
  max(CASE WHEN l_discount > 0.08 THEN 'timeout after ' || l_suppkey ELSE NULL END) AS error,
  max(CAST(floor(l_extendedprice / 10) AS BIGINT)) AS input_tokens, max(CAST(l_quantity AS BIGINT)) AS output_tokens
FROM lineitem GROUP BY l_orderkey, l_linenumber % 8, l_linenumber"""
STANDINS["v_section_results"] = STANDINS["v_section_results"].replace(
    "GROUP BY l_orderkey, l_linenumber % 8, l_linenumber", "GROUP BY 1, 2, 3")

# Crawl frontier: URLs seen per site, and whether each was visited.
STANDINS["v_frontier"] = """
SELECT site, url, page_type, min(depth) AS depth, min(ord) AS ord, max(visited) = 1 AS visited,
  min(CASE page_type WHEN 'about' THEN 1 WHEN 'product' THEN 3 WHEN 'contact' THEN 5 ELSE 10 END) AS priority
FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 's0' ELSE 's' || l_suppkey END AS site,
    'https://s.example.com/' || l_partkey AS url,
    CASE l_partkey % 4 WHEN 0 THEN 'about' WHEN 1 THEN 'product' WHEN 2 THEN 'contact' ELSE 'other' END AS page_type,
    CAST(l_linenumber % 5 AS BIGINT) AS depth, l_orderkey * 10 + l_linenumber AS ord,
    CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS visited FROM lineitem) x
GROUP BY site, url, page_type"""

# Run log: one event per fetched page or job step.
STANDINS["v_events"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS job_id, CAST(ts AS TIMESTAMP) AS ts, event_type,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'crawling' WHEN 'signup' THEN 'extracting'
    WHEN 'error' THEN 'analyzing' ELSE 'generating' END AS phase,
  CASE event_type WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume' ELSE NULL END AS control,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 301 ELSE 200 END AS status_code,
  CASE WHEN event_id % 17 = 0 THEN 'Duplicate content' WHEN event_id % 29 = 0 THEN 'Blocked by robots.txt'
    ELSE NULL END AS error,
  CAST(floor(value) AS BIGINT) AS external_links, 'https://h.example.com/' || event_id % 700 AS url,
  props AS hash
FROM events"""

# Upload rows, some of them wrong, some of them already registered or repeated.
STANDINS["v_uploads"] = """
SELECT c_custkey AS row_no,
  CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN '  ' || c_name || '  ' WHEN 2 THEN replace(c_name, '0', 'Long name ' ||
    c_name) || c_name || c_name || c_name ELSE c_name END AS company_name,
  CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'no-dot' WHEN 2 THEN ' new' || c_custkey % 40 || '.example.com '
    WHEN 3 THEN 'https://www.customer-' || substr(c_name, 10) || '.example.com'
    WHEN 4 THEN 'http://shared.example.com/' WHEN 5 THEN 'http://shared.example.com'
    WHEN 6 THEN 'new' || c_custkey % 40 || '.example.com/' ELSE 'https://u' || c_custkey % 300 || '.example.org/x/' END
    AS website_url,
  CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN replace(c_name, '0', 'industry' || c_name) || c_name ELSE c_mktsegment
    END AS industry
FROM customer"""

# robots.txt texts, one per host of the crawl.
STANDINS["v_robots"] = """
SELECT domain, CASE length(domain) % 7
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /fr/1' || chr(10) ||
    'Crawl-delay: 2' || chr(10) || 'Sitemap: https://' || domain || '/sitemap.xml' || chr(10) || 'Disallow: /e*/9'
  WHEN 1 THEN 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: HTTP://no'
  WHEN 2 THEN 'User-agent: SiteBrief-Bot' || chr(13) || chr(10) || 'Disallow: /*?page=' || chr(10) || chr(10) ||
    'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Crawl-delay: 9'
  WHEN 3 THEN '# note' || chr(10) || 'User-agent: * # all' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /*.html$' ||
    chr(10) || 'no directive' || chr(10) || 'Crawl-delay: abc' || chr(10) || 'Sitemap: http://' || domain || '/a.xml'
  WHEN 4 THEN 'USER-AGENT: *' || chr(10) || 'Disallow : /en/' || chr(10) || 'Allow: /en/' || chr(10) || 'Crawl-delay: 0.5'
  WHEN 5 THEN 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: sitebrief-bot' || chr(10) ||
    'Crawl-delay: 0' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /en/6' || chr(10) || 'Allow: /*/61'
  ELSE '' END AS content
FROM (SELECT DISTINCT regexp_extract(url, '//([^/?#]+)', 1) AS domain FROM pages) x"""

# Sitemap documents: a forest of index files (children of k are 2k+10 and 2k+11) with url lists as leaves.
STANDINS["v_sitemaps"] = """
SELECT k AS doc_id, k < 10 AS is_root, 'https://sm.example.com/' || k || '.xml' AS sitemap_url, CASE
  WHEN k % 13 = 12 THEN '<urlset><url><loc>https://broken.example.com/</loc>'
  WHEN k % 17 = 16 THEN '<feed><url><loc>https://feed.example.com/</loc></url></feed>'
  WHEN k % 4 = 3 OR k >= 60 THEN '<?xml version="1.0"?><urlset' || CASE WHEN k % 3 = 0 THEN '' ELSE
      ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' END || '>' ||
    '<url><loc> https://sm.example.com/a/' || k || ' </loc><lastmod>2024-01-0' || (k % 9 + 1) ||
      '</lastmod><priority>0.' || k % 10 || '</priority></url>' ||
    '<url><loc>https://sm.example.com/b/' || k || '</loc><changefreq>daily</changefreq><priority>high</priority></url>' ||
    '<url><lastmod>2024-01-01</lastmod></url>' ||
    '<url><loc>https://sm.example.com/b/' || k || '</loc></url></urlset>'
  ELSE '<sitemapindex' || CASE WHEN k % 2 = 0 THEN ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' ELSE '' END ||
    '><sitemap><loc>https://sm.example.com/' || (k * 2 + 10) || '.xml</loc></sitemap>' ||
    '<sitemap><loc>https://sm.example.com/' || k || '.xml</loc></sitemap>' ||
    '<sitemap><loc>https://sm.example.com/' || (k * 2 + 11) || '.xml</loc></sitemap>' ||
    '<sitemap><loc>https://sm.example.com/' || k % 10 || '.xml</loc></sitemap></sitemapindex>' END AS xml
FROM (SELECT c_custkey AS k FROM customer) x"""

# Raw mentions before merging. One company holds a third of them; some have no confidence or source.
STANDINS["v_mentions"] = """
SELECT c_custkey * 2 AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'c0' ELSE 'c' || c_nationkey END AS company_id,
  CASE c_custkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'email' ELSE 'phone' END AS type,
  CASE c_custkey % 4
    WHEN 0 THEN CASE c_custkey % 36 WHEN 0 THEN 'John' WHEN 4 THEN 'J.' WHEN 8 THEN 'JOHN A.' WHEN 12 THEN 'j'
      WHEN 16 THEN 'Jane' WHEN 20 THEN 'Mary Ann' WHEN 24 THEN 'M.' WHEN 28 THEN '' ELSE 'Robert' END || ' ' ||
      CASE c_custkey % 28 WHEN 0 THEN 'Smith' WHEN 4 THEN 'Jones ' WHEN 8 THEN 'Miller' ELSE 'Lee' || c_custkey % 50 END
    WHEN 1 THEN CASE c_custkey % 20 WHEN 1 THEN 'Acme Robotics' WHEN 5 THEN 'Globex' WHEN 9 THEN 'Initech Systems'
      WHEN 13 THEN 'Umbrella' ELSE c_name END || CASE c_custkey % 28 WHEN 1 THEN ' Inc.' WHEN 5 THEN ' LLC' WHEN 9 THEN
      ' Corporation' WHEN 13 THEN ', Ltd' ELSE '' END
    WHEN 2 THEN CASE c_custkey % 8 WHEN 2 THEN 'Sales' ELSE 'sales' END || c_custkey % 60 || '@acme.io '
    ELSE CASE c_custkey % 8 WHEN 3 THEN '+1 (415) 555-' ELSE '415.555.' END || (1000 + c_custkey % 70) END AS value,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(50 + c_custkey % 9 * 5 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'https://p/' || c_custkey % 37 END AS source_url,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'near ' || c_custkey % 41 END AS context,
  CASE WHEN c_custkey % 8 = 0 THEN 'Role ' || c_custkey % 3 ELSE NULL END AS role,
  CASE WHEN c_custkey % 8 = 1 THEN 'partner' WHEN c_custkey % 8 = 5 THEN 'client' ELSE NULL END AS relationship
FROM customer
UNION ALL
SELECT p_partkey * 2 + 1, CASE WHEN p_partkey % 3 = 0 THEN 'c0' ELSE 'c' || p_partkey % 25 END,
  CASE p_partkey % 2 WHEN 0 THEN 'product' ELSE 'location' END,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name || ' ' || p_brand || ' ' || p_type END, CAST(p_retailprice AS DOUBLE) / 2000,
  'https://q/' || p_partkey % 31, 'by ' || p_partkey % 29, NULL, NULL
FROM part"""
