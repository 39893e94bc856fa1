"""URL columns. Five different normal forms exist on purpose; none replaces another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str methods see it, in a form Java and RE2 both read.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Query keys that only track visitors.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid",
]

# Well-formed site URL, looser upload form, blocked networks.
SITE_URL = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)
UPLOAD_URL = r"(?i)^https?://[a-z0-9][-a-z0-9]*(\.[a-z0-9][-a-z0-9]*)+"
BLOCKED_NETWORK = (
    r"localhost|127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|::1|0\.0\.0\.0|169\.254\.|\.local$|\.internal$"
)

# RFC 3986 appendix B, group numbers: 1 scheme, 2 authority mark, 3 authority, 4 path, 5 query.
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


# The same class for Java alone, which matches it several times faster.
JAVA_WS = r"(?U:[\s\x1c-\x1f])"


def strip(c: Column) -> Column:
    """Python's strip. Most texts have no space at their ends; two characters decide that."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(JAVA_WS), F.regexp_replace(c, f"^{JAVA_WS}+|{JAVA_WS}+$", "")).otherwise(c)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to an expression that reads it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(raw_path(url), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 5)


def _or(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def _has_http(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def _rstrip_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def with_scheme(url: Column) -> Column:
    return F.when(_has_http(url), url).otherwise(F.concat(F.lit("https://"), url))


def normalize_input(url: Column) -> Column:
    """What a user typed, with a scheme and at least the root path; fragment dropped."""
    def rebuild(u):
        q = query(u)
        tail = F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
        return F.concat(scheme(u), F.lit("://"), netloc(u), _or(path(u), "/"), tail)

    return let(with_scheme(strip(url)), rebuild)


def _decode(c: Column) -> Column:
    # A % that starts no escape is kept as text.
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_query(q: Column) -> Column:
    """Sorted query, first value per key, tracking keys dropped, values decoded."""
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p, i: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            i.alias("i"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))
    first = F.aggregate(
        kept,
        start,
        lambda acc, p: F.struct(
            p["k"].alias("last"),
            F.when(acc["last"].eqNullSafe(p["k"]), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.concat(p["k"], F.lit("="), p["v"]))))
            .alias("out"),
        ),
    )
    return F.array_join(first["out"], "&")


def canonical(url: Column) -> Column:
    """The crawl frontier's form, used to tell seen URLs from new ones."""
    p = _or(path(url), "/")
    p = F.when((p != "/") & p.endswith("/"), _rstrip_slash(p)).otherwise(p)
    # Only URLs with a query pay for taking it apart.
    q = F.when(query(url) == "", F.lit("")).otherwise(canonical_query(query(url)))
    return F.concat(
        _or(scheme(url), "https"), F.lit("://"), F.lower(netloc(url)), p,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def crawl_form(url: Column) -> Column:
    """The crawler's own form: http(s) only, default port text removed, query always dropped.

    The port text is removed wherever it stands in the host, so ``host:8080`` on http
    becomes ``host80``; this is kept because page keys depend on it.
    """
    s, h, p = scheme(url), F.lower(netloc(url)), _or(path(url), "/")
    h = F.when(s == "http", F.replace(h, F.lit(":80"), F.lit(""))).otherwise(F.replace(h, F.lit(":443"), F.lit("")))
    p = F.when((F.length(p) > 1) & p.endswith("/"), _rstrip_slash(p)).otherwise(p)
    return F.when(s.isin("http", "https") & (netloc(url) != ""), F.concat(s, F.lit("://"), h, p))


def _starts_any(c: Column, *prefixes: str) -> Column:
    test = c.startswith(prefixes[0])
    for p in prefixes[1:]:
        test = test | c.startswith(p)
    return test


def _resolve_dots(segments: Column) -> Column:
    done = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(
        F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done), "/"
    )
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def _merge_path(base_path: Column, rel_path: Column) -> Column:
    """Base path without its last segment, then the relative one; empty inner segments go."""
    parts = F.split(base_path, "/")
    parts = F.when(
        F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
    allp = F.concat(parts, F.split(rel_path, "/"))
    n = F.size(allp)
    return F.filter(allp, lambda s, i: (i == 0) | (i == n - 1) | (s != ""))


def join(base: Column, href: Column) -> Column:
    """Resolve a reference against its page; the query is not needed by the caller."""
    parts = F.struct(
        scheme(href).alias("hs"), netloc(href).alias("hn"), path(href).alias("hp"), scheme(base).alias("bs"),
        F.concat(scheme(base), F.lit("://"), netloc(base)).alias("origin"))

    def resolve(p):
        relative = (p["hs"] == "") | ((p["hs"] == p["bs"]) & (p["hn"] == ""))
        return (
            F.when(~relative, href)
            .when(p["hn"] != "", F.concat(p["bs"], F.lit("://"), p["hn"], p["hp"]))
            .when(p["hp"] == "", F.concat(p["origin"], path(base)))
            .when(p["hp"].startswith("/") & ~p["hp"].contains("/."), F.concat(p["origin"], p["hp"]))
            .when(p["hp"].startswith("/"), F.concat(p["origin"], let(F.split(p["hp"], "/"), _resolve_dots)))
            .otherwise(F.concat(p["origin"], let(_merge_path(path(base), p["hp"]), _resolve_dots)))
        )

    return let(parts, resolve)


def link_resolve(base: Column, href: Column) -> Column:
    skip = (href == "") | _starts_any(href, "javascript:", "mailto:", "tel:", "#", "data:")
    return F.when(~skip, let(join(base, href), crawl_form))


def external_form(base: Column, href: Column) -> Column:
    """Link text as the social-link detector sees it; null when it is no http(s) URL."""
    full = (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(scheme(base), F.lit("://"), netloc(base), href))
        .otherwise(href)
    )
    skip = (href == "") | _starts_any(href, "javascript:", "mailto:", "tel:", "#")
    return F.when(~skip & _has_http(full), full)


def registry_key(url: Column) -> Column:
    return _rstrip_slash(url)


def domain(url: Column) -> Column:
    """Authority with its port, or the input itself when there is none."""
    return F.when(netloc(url) == "", url).otherwise(netloc(url))


def robots_path(url: Column) -> Column:
    p, q = _or(path(url), "/"), query(url)
    full = F.concat(p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))


def format_error(url: Column) -> Column:
    """Null for a valid site URL, else the message."""
    def check(n):
        host = F.regexp_extract(netloc(n), "^([^:]*)", 1)
        return (
            F.when(url.isNull() | (url == ""), F.lit("URL is required"))
            .when(~n.rlike(SITE_URL), F.concat(F.lit("Invalid URL format: "), url))
            .when(netloc(n) == "", F.lit("URL must include a domain"))
            .when((host == "") | host.startswith(".") | host.endswith("."), F.lit("Invalid domain in URL"))
            .when((host != "localhost") & ~host.contains("."), F.lit("Domain must include a TLD (e.g., .com, .org)"))
        )

    return let(normalize_input(url), check)


def upload_error(url: Column) -> Column:
    """The looser check of uploads: a host with at least one dot."""
    return F.when(url.isNull() | (url == ""), F.lit("URL is required")).when(
        ~with_scheme(url).rlike(UPLOAD_URL), F.lit("Invalid URL format")
    )


def blocked_reason(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(url.isNull() | (url == ""), F.lit("URL is required"))
        .when(~_has_http(low), F.lit("URL must start with http:// or https://"))
        .when(low.rlike(BLOCKED_NETWORK), F.lit("URL points to a blocked network address"))
    )


def is_pdf(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".pdf") | low.contains("format=pdf") | low.contains("type=pdf")


def is_pdf_bytes(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def in_scope(url: Column, base: Column, depth: Column, max_depth: int, exclusions: list[str]) -> Column:
    """Same host as the base (both lowercased), not too deep, matching no exclusion pattern."""
    ok = (F.lower(netloc(url)) == F.lower(netloc(base))) & (depth <= max_depth)
    if exclusions:
        ok = ok & ~url.rlike("(?i)" + "|".join(f"(?:{p})" for p in exclusions))
    return ok
