"""Merging, clustering and graph queries."""

from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions.urls import WS
from sitebrief.operators import dedup as D
from sitebrief.operators.clusters import greedy_leaders
from sitebrief.operators.graph import link_depth as bfs
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.registry import query
from sitebrief.session import cut_lineage

_xkey = f"CASE type WHEN 'phone' THEN regexp_replace({O.strip('lower(value)')}, '\\D', '', 'g') ELSE {O.strip('lower(value)')} END"
_name = O.strip("lower(value)")
_parts = f"list_transform(list_filter(string_split_regex({_name}, '{WS}+'), lambda p: p <> ''), lambda p: rtrim(p, '.'))"

cluster_sql = f"""ex AS (SELECT *, {_xkey} AS cluster, 0 AS o1 FROM v_mentions WHERE type IN ('email', 'phone')),
pn0 AS (SELECT *, {_name} AS n, {_parts} AS parts, -length(value) AS o1 FROM v_mentions WHERE type = 'person'),
pn AS (SELECT *, len(parts) >= 2 AS multi, CASE WHEN len(parts) >= 2 THEN parts[1] ELSE '' END AS fst,
  CASE WHEN len(parts) >= 2 THEN parts[-1] ELSE n END AS lst FROM pn0),
pk AS (SELECT company_id, multi, lst, fst, substr(fst, 1, 1) AS letter, multi AND length(fst) = 1 AS ini,
  min((o1, pos)) AS pt FROM pn GROUP BY ALL),
ph AS (SELECT company_id, multi, lst, letter, min(pt) AS head, arg_min(ini, pt) AS hini FROM pk GROUP BY ALL),
pm AS (SELECT pk.*, CASE WHEN hini OR ini THEN head ELSE pt END AS lead FROM pk JOIN ph USING (company_id, multi, lst, letter)),
pc AS (SELECT pn.*, CAST(lead[2] AS VARCHAR) AS cluster FROM pn JOIN pm USING (company_id, multi, lst, fst)),
cl AS (SELECT company_id, type, cluster, o1, pos, value, confidence, source_url, context, role, relationship FROM ex
  UNION ALL SELECT company_id, type, cluster, o1, pos, value, confidence, source_url, context, role, relationship FROM pc),
mg AS (SELECT company_id, type, cluster, count(*) AS mentions, count(DISTINCT nullif(source_url, '')) AS n_sources,
  count(DISTINCT nullif(context, '')) AS n_contexts, min(nullif(source_url, '')) AS source_url,
  first({{'v': value, 'c': confidence}} ORDER BY coalesce(confidence, 0) DESC, o1, pos) AS best,
  first(role ORDER BY o1, pos) FILTER (WHERE role IS NOT NULL) AS role,
  coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS roles,
  coalesce(string_agg(DISTINCT relationship, ',' ORDER BY relationship), '') AS relationships FROM cl GROUP BY 1, 2, 3)"""
_merged = ("SELECT company_id, type, cluster, best.v AS value, round(least(1.0, coalesce(best.c, 0.5) + least(0.2, mentions * "
           "0.02)), 6)::DOUBLE AS confidence, mentions, n_sources, n_contexts, source_url, role FROM mg")
_cols = ["company_id", "type", "cluster", "value", "confidence", "mentions", "n_sources", "n_contexts", "source_url", "role"]


def _out(df):
    return df.withColumn("confidence", F.round("confidence", 6)).select(*_cols)


def _exact(t):
    return D.cluster_exact(t.v_mentions.filter("type IN ('email', 'phone')"))


def _persons(t):
    return D.cluster_persons(t.v_mentions.filter("type = 'person'"))


@query("entity_dedup_exact", f"WITH {cluster_sql} {_merged} WHERE type IN ('email', 'phone')")
def entity_dedup_exact(t):
    return _out(D.merge(_exact(t)))


@query("entity_dedup_person", f"WITH {cluster_sql} {_merged} WHERE type = 'person'")
def entity_dedup_person(t):
    return _out(D.merge(_persons(t)))


def org_name_sql(v):
    n = O.strip(f"lower({v})")
    for s in P.LEGAL_SUFFIXES:
        n = f"regexp_replace({n}, '{s.replace(chr(92) + 's', WS)}', '')"
    n = f"regexp_replace({n}, '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}]', '', 'g')"
    return O.strip(O.collapse(n))



# Greedy clusters, one name after the other: matches of all names by the definition (longest common subsequence by one
# number per name, a bit per character), then a walk along the order that keeps the leaders so far.
_greedy = """gm AS (SELECT DISTINCT ON (company_id, type, name) company_id, type, name, -length(value) AS o1, pos FROM gv ORDER BY
  company_id, type, name, o1, pos),
gr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY company_id, type ORDER BY o1, pos) AS r, string_split(name, '') AS cs FROM gm),
gp AS (SELECT a.company_id, a.type, a.r AS lo, b.r AS hi, a.name AS x, b.name AS y, a.cs AS xs, b.cs AS ys FROM gr a JOIN gr b ON
  a.company_id = b.company_id AND a.type = b.type AND a.r < b.r WHERE (a.type = 'org' AND (contains(a.name, b.name) OR
  contains(b.name, a.name))) OR (a.name <> '' AND b.name <> '' AND
  levenshtein(a.name, b.name) <= 0.15 * (length(a.name) + length(b.name)) + 0.000001)),
gl AS (SELECT *, (1::HUGEINT << length(x)) - 1 AS fullm FROM gp),
gs AS MATERIALIZED (SELECT company_id, type, lo, hi FROM gl WHERE (type = 'org' AND (contains(x, y) OR contains(y, x))) OR
  (x <> '' AND y <> '' AND 2.0 * (length(x) - bit_count(list_reduce(list_prepend(fullm, list_transform(ys, lambda c: list_sum(
    list_transform(range(len(xs)), lambda i: CASE WHEN xs[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & fullm))) / (length(x) + length(y)) >= 0.85)),
ge AS MATERIALIZED (SELECT company_id, type, hi AS r, list(lo) AS los FROM gs GROUP BY ALL),
gw AS (SELECT company_id, type, 0::BIGINT AS r, []::BIGINT[] AS leads, NULL::BIGINT AS lead FROM gr GROUP BY ALL
  UNION ALL SELECT w.company_id, w.type, gr.r, CASE WHEN list_has_any(coalesce(los, []), leads) THEN leads ELSE list_append(leads, gr.r) END,
    coalesce(list_min(list_intersect(los, leads)), gr.r)
  FROM gw w JOIN gr ON gr.company_id = w.company_id AND gr.type = w.type AND gr.r = w.r + 1
  LEFT JOIN ge ON ge.company_id = gr.company_id AND ge.type = gr.type AND ge.r = gr.r),
gk AS (SELECT gr.company_id, gr.type, gr.name, l.name AS leader, CAST(l.pos AS VARCHAR) AS cluster FROM gr JOIN gw USING (company_id, type, r)
  JOIN gr l ON l.company_id = gr.company_id AND l.type = gr.type AND l.r = gw.lead),
gc AS (SELECT gv.company_id, gv.type, cluster, -length(value) AS o1, pos, value, confidence, source_url, context, role, relationship FROM gv
  JOIN gk USING (company_id, type, name)
  UNION ALL SELECT company_id, type, CAST(pos AS VARCHAR), 0, pos, value, confidence, source_url, context, role, relationship
  FROM v_mentions WHERE type IN ('product', 'location') AND value = '')"""
_names = """gv AS (SELECT *, CASE WHEN type = 'org' THEN """ + org_name_sql("value") + """ ELSE lower(value) END AS name FROM v_mentions
  WHERE type = 'org' OR (type IN ('product', 'location') AND value <> ''))"""


# Each type by its own rule: all mentions with their clusters, then merged.
whole_sql = f"""{cluster_sql.split(',' + chr(10) + 'mg AS')[0]}, {_names}, {_greedy}, al AS (SELECT * FROM cl UNION ALL SELECT * FROM gc),
{'mg AS' + cluster_sql.split(',' + chr(10) + 'mg AS')[1].replace('FROM cl ', 'FROM al ')}"""


def _whole_of(t):
    # Used more than once below: the clusters are found once.
    return cut_lineage(D.cluster_all(t.v_mentions))


@query("entity_merge", f"WITH RECURSIVE {whole_sql} {_merged}")
def entity_merge(t):
    return _out(D.merge(D.cluster_all(t.v_mentions)))


@query("cluster_attributes", f"WITH RECURSIVE {whole_sql} SELECT company_id, type, cluster, roles, relationships FROM mg")
def cluster_attributes(t):
    return D.merge(D.cluster_all(t.v_mentions)).select("company_id", "type", "cluster", "roles", "relationships")


@query("cluster_sources", f"WITH RECURSIVE {whole_sql} SELECT DISTINCT company_id, type, cluster, source_url FROM al WHERE "
       "coalesce(source_url, '') <> ''")
def cluster_sources(t):
    """Sources of the merged entities of all types, as rows."""
    return D.cluster_sources(D.cluster_all(t.v_mentions))


@query("cluster_contexts", f"WITH RECURSIVE {whole_sql} SELECT DISTINCT company_id, type, cluster, context FROM al WHERE "
       "coalesce(context, '') <> ''")
def cluster_contexts(t):
    """Contexts of the merged entities of all types, as rows."""
    return D.cluster_contexts(D.cluster_all(t.v_mentions))


@query("dedup_summary", f"""WITH RECURSIVE {whole_sql}, b AS (SELECT company_id, count(*) AS n FROM al GROUP BY 1),
a AS (SELECT company_id, count(*) AS n FROM mg GROUP BY 1)
SELECT company_id, b.n AS original_count, a.n AS deduplicated_count, b.n - a.n AS removed FROM b JOIN a USING (company_id)""")
def dedup_summary(t):
    """Mentions and merged entities per company over all types."""
    whole = _whole_of(t)
    return D.summary(whole, D.merge(whole))


@query("entity_dedup_org", f"WITH RECURSIVE {whole_sql} {_merged} WHERE type = 'org'")
def entity_dedup_org(t):
    return _out(D.merge(D.cluster_orgs(t.v_mentions.filter("type = 'org'"))))


@query("entity_dedup_fuzzy", f"WITH RECURSIVE {whole_sql} {_merged} WHERE type IN ('product', 'location')")
def entity_dedup_fuzzy(t):
    return _out(D.merge(D.cluster_fuzzy(t.v_mentions.filter("type IN ('product', 'location')"))))


@query("person_match_links", f"""WITH {cluster_sql}, hd AS (SELECT company_id, multi, lst, fst, first(value ORDER BY o1, pos) AS
  known FROM pn GROUP BY ALL) SELECT DISTINCT company_id, value AS name, known, 'same' AS how FROM pn JOIN hd USING (company_id,
  multi, lst, fst) UNION ALL SELECT f.company_id, f.known, i.known, 'known is initial' FROM hd f JOIN hd i ON f.company_id =
  i.company_id AND f.lst = i.lst AND f.multi AND i.multi AND length(f.fst) > 1 AND length(i.fst) = 1 AND
  starts_with(f.fst, i.fst)""")
def person_match_links(t):
    """Matches among all names, as links to the first name of each class."""
    return D.person_match_links(t.v_mentions.filter("type = 'person'"))


@query("org_match_leaders", f"WITH RECURSIVE {_names.replace(' OR (type IN', ' AND NOT (type IN')}, {_greedy} SELECT company_id, "
       "name, leader AS known FROM gk")
def org_match_leaders(t):
    """Each normalized name of all mentions with the leader that it matches."""
    orgs = t.v_mentions.filter("type = 'org'").select(
        "company_id", "type", D.org_name(F.col("value")).alias("name"), (-F.length("value")).alias("o1"), F.col("pos").alias("o2"))
    first = orgs.groupBy("company_id", "type", "name").agg(F.min(F.struct("o1", "o2")).alias("at"))
    return greedy_leaders(first.select("company_id", "type", "name", "at.o1", "at.o2"), contain=True).select(
        "company_id", "name", F.col("leader").alias("known"))


# Suppliers are linked when one follows the other in an order.
_edges = """eg AS (SELECT DISTINCT site, src, dst FROM (SELECT 'r' || l_suppkey % 3 AS site, 's' || l_suppkey AS src,
  's' || lead(l_suppkey) OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) x WHERE dst IS NOT NULL)"""


@query("link_depth", f"""WITH RECURSIVE {_edges},
bf AS (SELECT DISTINCT site, 's' || substr(site, 2) AS url, 0 AS depth FROM eg
  UNION SELECT bf.site, eg.dst, bf.depth + 1 FROM bf JOIN eg ON eg.site = bf.site AND eg.src = bf.url WHERE bf.depth < 4)
SELECT site, url, CAST(min(depth) AS BIGINT) AS depth FROM bf GROUP BY 1, 2""")
def link_depth(t):
    edges = t.sql(f"WITH {_edges} SELECT * FROM eg")
    starts = edges.select("site", F.concat(F.lit("s"), F.substring("site", F.lit(2), F.lit(9))).alias("url"))
    return bfs(edges, starts, max_depth=4)
