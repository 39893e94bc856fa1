"""Extraction: one text row to many entity rows, and the rules on model spans."""

from pyspark.sql import functions as F

from sitebrief.functions import extract as E
from sitebrief.functions import mentions as M
from sitebrief.functions import patterns as P
from sitebrief.functions.urls import WS
from sitebrief.plans import oracle_sql as O
from sitebrief.plans.registry import query

_bad = ", ".join(O.lit(d) for d in P.PLACEHOLDER_DOMAINS)


def email_ok_sql(e):
    d = f"regexp_extract({e}, '@([^@]*)$', 1)"
    return (f"contains({e}, '@') AND {d} NOT IN ({_bad}) AND NOT regexp_matches({d}, '\\.(png|jpg)$') "
            f"AND length({d}) >= 3 AND contains({d}, '.') AND length({e}) > length({d}) + 1")


def _found(name, pattern, source="v_texts", groups=0):
    cols = ", ".join([f"regexp_extract_all(text, {O.lit(pattern)}, {i}) AS a{i}" for i in range(groups + 1)])
    vals = ", ".join(f"a{i}[i] AS g{i}" for i in range(groups + 1))
    arrs = ", ".join(f"a{i}" for i in range(groups + 1))
    return (f"{name} AS (SELECT page_id, i, {vals} FROM (SELECT page_id, {arrs}, unnest(range(1, len(a0) + 1)) AS i "
            f"FROM (SELECT page_id, {cols} FROM {source})))")


_emails = f"""{_found('plain', E.EMAIL)}, {_found('hid', E.EMAIL_HIDDEN, groups=3)},
em AS (SELECT page_id, 0 AS k, i, g0 AS value, lower(g0) AS normalized, 0.95::DOUBLE AS confidence FROM plain
  UNION ALL SELECT page_id, 1, i, g0, lower(g1 || '@' || g2 || '.' || g3), 0.85::DOUBLE FROM hid),
em1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, normalized ORDER BY k, i) AS rn FROM em),
emails AS (SELECT page_id, value, normalized, confidence FROM em1 WHERE rn = 1 AND {email_ok_sql('normalized')})"""
_cols = ["page_id", "value", "normalized", "confidence"]


def _rows(t, fn, col, tech=False):
    df = fn(t.v_texts.select("page_id", "text"))
    return E.explode_entities(df.drop("text"), col, ["page_id"])


@query("email_extract", f"WITH {_emails} SELECT * FROM emails WHERE confidence > 0.9")
def email_extract(t):
    return _rows(t, E.with_emails, "emails").filter("confidence > 0.9").select(*_cols)


@query("email_obfuscated", f"WITH {_emails} SELECT * FROM emails WHERE confidence < 0.9")
def email_obfuscated(t):
    return _rows(t, E.with_emails, "emails").filter("confidence < 0.9").select(*_cols)


@query("email_valid", f"WITH {_found('plain', E.EMAIL)} SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, g0 AS value "
       f"FROM plain WHERE {email_ok_sql('lower(g0)')}")
def email_valid(t):
    df = t.v_texts.select("page_id", F.posexplode(F.regexp_extract_all("text", F.lit(E.EMAIL), F.lit(0))))
    return df.filter(E.email_ok(F.lower("col"))).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("value"))


_phones = ", ".join(_found(f"p{k}", p, groups=4 if k == 2 else 3) for k, p in enumerate(E.PHONES)) + """,
ph AS (""" + " UNION ALL ".join(
    f"SELECT page_id, {k} AS k, i, g0, '+1' || g1 || g2 || g3 AS normalized FROM p{k}" for k in range(4)) + """),
ph1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, normalized ORDER BY k, i) AS rn FROM ph),
phones AS (SELECT page_id, g0 AS value, normalized, 0.9::DOUBLE AS confidence FROM ph1 WHERE rn = 1)"""


@query("phone_extract", f"WITH {_phones} SELECT * FROM phones")
def phone_extract(t):
    return _rows(t, E.with_phones, "phones").select(*_cols)


_addr = ", ".join(_found(f"a_{k}", p) for k, p in enumerate(E.ADDRESSES)) + f""",
ad AS ({" UNION ALL ".join(f"SELECT page_id, {k} AS k, i, {O.strip('g0')} AS v FROM a_{k}" for k in range(3))}),
ad1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, {O.collapse('lower(v)')} ORDER BY k, i) AS rn FROM ad),
addresses AS (SELECT page_id, v AS value, v AS normalized, 0.8::DOUBLE AS confidence FROM ad1
  WHERE rn = 1 AND length(v) >= 15)"""


@query("address_extract", f"WITH {_addr} SELECT * FROM addresses")
def address_extract(t):
    return _rows(t, E.with_addresses, "addresses").select(*_cols)


_soc_pats = [(p, x) for p, xs in E.SOCIAL.items() for x in xs]
_skip = ", ".join(O.lit(h) for h in P.SOCIAL_TEXT_SKIP)
_handles = ", ".join(_found(f"s{k}", x, groups=1) for k, (_, x) in enumerate(_soc_pats)) + """,
so AS (""" + " UNION ALL ".join(
    f"SELECT page_id, {k} AS k, i, g0, '{p}' AS platform, trim(g1, '/@') AS handle FROM s{k}"
    for k, (p, _) in enumerate(_soc_pats)) + f"""),
so1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, platform, lower(handle) ORDER BY k, i) AS rn FROM so
  WHERE lower(handle) NOT IN ({_skip})),
handles AS (SELECT page_id, g0 AS value, handle AS normalized, 0.9::DOUBLE AS confidence, platform FROM so1 WHERE rn = 1)"""


@query("social_handle_extract", f"WITH {_handles} SELECT * FROM handles")
def social_handle_extract(t):
    return _rows(t, E.with_social_handles, "handles").select(*_cols, F.col("extra")["platform"].alias("platform"))


def _tech_count(p):
    q = p.replace(r"(?!\s*Script)", "").replace("(?!Hub)", "").replace(r"\s", WS)
    n = f"len(regexp_extract_all(x, {O.lit('(?i)' + q)}))"
    if "(?!" in p and "Script" in p:
        n += f" - len(regexp_extract_all(x, {O.lit('(?i)' + q + WS + '*Script')}))"
    return n


_tech = f"""tx AS (SELECT page_id, {O.ascii_words('text')} AS x FROM v_texts),
tc AS (SELECT page_id, unnest([{', '.join(
    f"{{'c': '{c}', 'n': '{n}', 'k': {_tech_count(p)}}}" for c, n, p in E.TECH)}]) AS r FROM tx),
tech AS (SELECT page_id, r.n AS technology, r.c AS category, CAST(r.k AS BIGINT) AS mentions,
  round(least(0.9::DOUBLE, 0.7::DOUBLE + r.k * 0.05::DOUBLE), 6) AS confidence FROM tc WHERE r.k > 0)"""


@query("tech_stack_extract", f"WITH {_tech} SELECT * FROM tech")
def tech_stack_extract(t):
    df = _rows(t, E.with_tech_stack, "tech")
    return df.select("page_id", F.col("normalized").alias("technology"), F.col("extra")["category"].alias("category"),
                     F.col("extra")["mentions"].cast("bigint").alias("mentions"),
                     F.round("confidence", 6).alias("confidence"))


_structured = f"""{_emails}, {_phones}, {_addr}, {_handles}, {_tech},
allent AS (SELECT page_id, 'email' AS type, normalized, confidence FROM emails
  UNION ALL SELECT page_id, 'phone', normalized, confidence FROM phones
  UNION ALL SELECT page_id, 'address', normalized, confidence FROM addresses
  UNION ALL SELECT page_id, 'social_handle', normalized, confidence FROM handles
  UNION ALL SELECT page_id, 'tech_stack', technology, confidence FROM tech)"""


@query("structured_extract_all", f"WITH {_structured} SELECT v.source_url, type, normalized, "
       "round(confidence, 6) AS confidence FROM allent JOIN v_texts v USING (page_id)")
def structured_extract_all(t):
    df = E.entities(t.v_texts.select("source_url", "text"), tech_stack=True)
    return df.select("source_url", "type", "normalized", F.round("confidence", 6).alias("confidence"))


def type_sql(table, label="label"):
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query("mention_label_map", f"SELECT span_id, label, {type_sql(P.LABELS)} AS type, {type_sql(P.PAGE_LABELS)} AS "
       f"page_type FROM v_spans WHERE {type_sql(P.LABELS)} IS NOT NULL")
def mention_label_map(t):
    df = t.v_spans.select("span_id", "label", M.entity_type(F.col("label")).alias("type"),
                          M.entity_type(F.col("label"), page_level=True).alias("page_type"))
    return df.filter(F.col("type").isNotNull())


_words = "len(list_filter(string_split_regex(value, '\\s+'), lambda w: w <> ''))"
conf_sql = f"""greatest(0.0, least(1.0, 0.7::DOUBLE - CASE WHEN length(trim(value)) < 2 THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(value, '^\\p{{Lu}}') THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN {_words} > 1 THEN 0.05::DOUBLE * least({_words} - 1, 3) ELSE 0 END
  - CASE WHEN value = upper(value) AND value <> lower(value) AND length(value) > 3 THEN 0.1::DOUBLE ELSE 0 END))"""


@query("mention_confidence", f"SELECT span_id, value, round({conf_sql}, 6) AS confidence FROM v_spans "
       f"WHERE round({conf_sql}, 6) >= 0.5")
def mention_confidence(t):
    df = t.v_spans.select("span_id", "value", F.round(M.confidence(F.col("value")), 6).alias("confidence"))
    return df.filter("confidence >= 0.5")


role_sql = "CASE " + " ".join(
    f"WHEN regexp_matches(context, {O.lit('(?i)' + p)}) THEN '{r}'" for p, r in P.ROLES) + " END"
rel_sql = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(context), {O.lit(w)})" for w in ws) + f" THEN '{r}'"
    for r, ws in P.RELATIONSHIPS) + " END"


@query("role_detect", f"SELECT span_id, context, {role_sql} AS role FROM v_spans")
def role_detect(t):
    return t.v_spans.select("span_id", "context", M.role(F.col("context")).alias("role"))


@query("org_relationship", f"SELECT span_id, context, {rel_sql} AS relationship FROM v_spans")
def org_relationship(t):
    return t.v_spans.select("span_id", "context", M.relationship(F.col("context")).alias("relationship"))


# The rule model in the check's own patterns: matches are marked in a copy of the text, their places follow from the pieces;
# a later rule's match stands if no earlier rule's does where it is.
_RULES_SQL = [
    (r"\\$\\d[\\d,.]*(?:\\s(?:million|billion))?", "MONEY"), (r"\\d+(?:\\.\\d+)?%", "PERCENT"), (r"\\b(?:19|20)\\d\\d\\b", "DATE"),
    (r"\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*\\s(?:Inc|LLC|Ltd|Corp|Company)\\b\\.?", "ORG"),
    (r"\\b[A-Z][a-z]+(?:\\s[A-Z]\\.)?(?:\\s[A-Z][a-z]+){1,2}\\b", "PERSON"),
]


def spans_sql(texts):
    """CTE rule_spans (page_id, s, e, label, value) over a table with page_id and text."""
    out = [f"rt AS (SELECT page_id, coalesce(text, '') AS text, {O.ascii_words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS x FROM {texts})"]
    for k, (p, label) in enumerate(_RULES_SQL):
        p = p.replace("\\\\", "\\")
        out.append(f"rp{k} AS (SELECT page_id, text, string_split(regexp_replace(x, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM rt)")
        out.append(f"rm{k} AS (SELECT page_id, text, (list_sum(list_transform(ps[:i], lambda q: length(q))) - greatest(i - 1, 0))::INT AS s, "
                   f"strpos(ps[i + 1], chr(2)) - 1 AS n FROM (SELECT page_id, text, ps, unnest(range(1, len(ps))) AS i FROM rp{k}))")
        before = " ".join(f"AND NOT EXISTS (SELECT 1 FROM rk{j} o WHERE o.page_id = m.page_id AND o.s < m.s + m.n AND m.s < o.s + o.n)" for j in range(k))
        out.append(f"rk{k} AS (SELECT page_id, s, n, substr(text, s + 1, n) AS value, '{label}' AS label FROM rm{k} m WHERE true {before})")
    out.append("rule_spans AS (" + " UNION ALL ".join(f"SELECT page_id, s, (s + n)::INT AS e, label, value FROM rk{k}" for k in range(len(_RULES_SQL))) + ")")
    return ",\n".join(out)


def _mentions_sql(texts):
    return (f"WITH {spans_sql(texts)} SELECT page_id, s, e, label, {type_sql(P.LABELS)} AS type, value, round({conf_sql}, 6) AS confidence "
            f"FROM rule_spans WHERE {type_sql(P.LABELS)} IS NOT NULL AND round({conf_sql}, 6) >= 0.5")


def mention_columns(df):
    return df.select("page_id", "s", "e", "label", "type", "value", F.round("confidence", 6).alias("confidence"))


@query("mention_spans", _mentions_sql("v_texts"))
def mention_spans(t):
    """The rule model's mentions, with their places."""
    return mention_columns(M.mention_extract(t.v_texts.select("page_id", "text")))


@query("mention_extract")
def mention_extract(t):
    df = M.mention_extract(t.v_texts.select("page_id", "text"))
    return df.select("page_id", "s", "e", "label", "type", "value", F.round("confidence", 6).alias("confidence"),
                     "context", F.get(F.map_keys("extra"), F.lit(0)).alias("extra_key"), F.get(F.map_values("extra"), F.lit(0)).alias("extra_value"))


@query("answer_sources", f"""WITH a AS (SELECT answer_id, CASE WHEN strpos(answer, 'SOURCES:') > 0
  THEN substr(answer, strpos(answer, 'SOURCES:') + 8) ELSE '' END AS tail FROM v_answers)
SELECT answer_id, array_to_string(regexp_extract_all(tail, 'https?://[^{WS[1:-1]}\\]>]+'), ' ') AS sources FROM a""")
def answer_sources(t):
    return t.v_answers.select("answer_id", F.array_join(M.answer_sources(F.col("answer")), " ").alias("sources"))


# Short templates of our own; a user passes any others.
TEMPLATES = {sid: f"Write the section {name} of {{company_name}} ({{website_url}}, {{industry}})." for sid, name, _ in
             P.SECTIONS}
SECTION_ORDER = [s for s, _, _ in sorted((x for x in P.SECTIONS if x[2] > 0), key=lambda x: x[2])] + [
    "executive_summary"]


@query("prompt_render", f"""WITH s(ord, section, name) AS (VALUES {', '.join(
    f"({i}, '{s}', {O.lit(dict((a, b) for a, b, _ in P.SECTIONS)[s])})" for i, s in enumerate(SECTION_ORDER))})
SELECT company_id, CAST(ord AS BIGINT) AS ord, section, 'Write the section ' || name || ' of ' || company_name || ' ('
  || website_url || ', ' || coalesce(industry, 'Unknown') || ').' AS prompt FROM v_companies, s""")
def prompt_render(t):
    values = {
        "company_name": F.coalesce("company_name", F.lit("Unknown Company")),
        "website_url": F.coalesce("website_url", F.lit("")),
        "industry": F.coalesce("industry", F.lit("Unknown")),
    }
    prompts = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(s).alias("section"),
                 M.render(TEMPLATES[s], values).alias("prompt")) for i, s in enumerate(SECTION_ORDER)])
    return t.v_companies.select("company_id", F.inline(prompts))
