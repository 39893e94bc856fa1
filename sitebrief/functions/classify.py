"""Page types from URL and text, and social links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions import urls
from sitebrief.functions.urls import WS

_TYPED = P.PAGE_TYPES[:-1]


def unicode_pattern(p: str) -> str:
    """Ignore case; word characters and white space in the Unicode sense."""
    return "(?iU)" + p.replace(r"\s", WS)


def page_type_first_match(url: Column) -> Column:
    path = F.lower(urls.path(url))
    out = None
    for t in _TYPED:
        hit = path.rlike("|".join(f"(?:{p})" for p in P.PATH_PATTERNS[t]))
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out.otherwise("other")


def page_priority(page_type: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(t) for t in P.PAGE_TYPES]), page_type)
    return F.when(rank > 0, rank).otherwise(F.lit(10)).cast("bigint")


_URL_RULES = [(t, p, w) for t in _TYPED for p, w in P.URL_WEIGHTS[t]]


def with_url_score(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds url_type, url_confidence (null without a match) and url_matched (pattern texts)."""
    weights = F.array(*[F.lit(w) for _, _, w in _URL_RULES])
    types = F.array(*[F.lit(t) for t, _, _ in _URL_RULES])
    texts = F.array(*[F.lit(p) for _, p, _ in _URL_RULES])
    # Path once, then the numbers of the matching rules once; the rest reads those numbers.
    df = df.withColumn("_path", F.lower(urls.path(F.col(url))))
    hits = F.array_compact(
        F.array(*[F.when(F.col("_path").rlike(f"(?i){p}"), F.lit(i)) for i, (_, p, _) in enumerate(_URL_RULES)])
    )
    df = df.withColumn("_hits", hits)
    best = F.array_max(
        F.transform("_hits", lambda i: F.struct(F.get(weights, i).alias("w"), (-i).alias("o")))
    )
    return (
        df.withColumn("_best", best)
        .withColumn("url_type", F.get(types, -F.col("_best.o")))
        .withColumn("url_confidence", F.col("_best.w"))
        .withColumn("url_matched", F.transform("_hits", lambda i: F.get(texts, i)))
        .drop("_path", "_hits", "_best")
    )


def with_content_score(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds content_type and content_confidence (null without a match) and content_matched."""
    df = df.withColumn("_low", F.lower(text))
    scored, matched = [], []
    for order, t in enumerate(_TYPED):
        total, names = F.lit(0.0), []
        for p, w in P.CONTENT_WEIGHTS[t]:
            # The longest plain word of the pattern must occur before the pattern is counted.
            word = max(re.findall(r"[a-z]{3,}(?!\?)", p.replace(r"\b", " ").replace(r"\s", " ")), key=len)
            n = F.when(F.col("_low").contains(word), F.regexp_count(F.col(text), F.lit(unicode_pattern(p)))).otherwise(0)
            total = total + F.least(n * F.lit(w) * F.lit(0.3), F.lit(w))
            names.append(F.when(F.col("_low").contains(word) & F.col(text).rlike(unicode_pattern(p)), F.lit(p)))
        score = F.least(total / 2.0, F.lit(1.0))
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("o"), F.lit(t).alias("t")))
        matched.append(F.when(F.col("content_type") == t, F.array_compact(F.array(*names))))
    df = df.withColumn("_best", F.array_max(F.array(*scored)))
    hit = F.col("_best.score") > 0
    return (
        df.withColumn("content_type", F.when(hit, F.col("_best.t")))
        .withColumn("content_confidence", F.when(hit, F.col("_best.score")))
        .withColumn("content_matched", F.coalesce(*matched))
        .drop("_best", "_low")
    )


def with_page_type(df: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """Adds page_type, confidence and match_source from both scores."""
    df = with_content_score(with_url_score(df, url), text)
    u, c = F.col("url_confidence"), F.col("content_confidence")
    same = F.col("url_type") == F.col("content_type")
    by_url = F.struct(F.col("url_type").alias("t"), u.alias("c"), F.lit("url").alias("s"))
    by_text = F.struct(F.col("content_type").alias("t"), c.alias("c"), F.lit("content").alias("s"))
    both = F.struct(
        F.col("url_type").alias("t"), F.least((u + c) / 1.5, F.lit(1.0)).alias("c"), F.lit("combined").alias("s")
    )
    unsure = F.struct(F.col("url_type").alias("t"), (u * 0.9).alias("c"), F.lit("url").alias("s"))
    default = F.struct(F.lit("other").alias("t"), F.lit(0.5).alias("c"), F.lit("default").alias("s"))
    pick = (
        F.when(u.isNull() & c.isNull(), default)
        .when(c.isNull(), by_url)
        .when(u.isNull(), by_text)
        .when(same, both)
        .when(u >= c * 1.2, by_url)
        .when(c >= u * 1.2, by_text)
        .otherwise(unsure)
    )
    return (
        df.withColumn("_p", pick)
        .withColumn("page_type", F.col("_p.t"))
        .withColumn("confidence", F.col("_p.c"))
        .withColumn("match_source", F.col("_p.s"))
        .drop("_p")
    )


def social_platform(url: Column) -> Column:
    """Platform by exact host, or null. The host list is short: an expression, no join."""
    def pick(host):
        out = None
        for name, hosts in P.PLATFORM_HOSTS.items():
            out = F.when(host.isin(*hosts), name) if out is None else out.when(host.isin(*hosts), name)
        return out

    return urls.let(F.lower(urls.netloc(url)), pick)


def _first_group(url: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, f"(?i){p}", 1), F.lit("")) for p in patterns])


def with_social_link(df: DataFrame, url: str = "url") -> DataFrame:
    """Keeps social links only; adds platform, link_type and handle (null when not found)."""
    u = F.col(url)
    df = df.withColumn("platform", social_platform(u)).filter(F.col("platform").isNotNull())
    handle, kind = None, None
    for name, pats in P.PLATFORM_HANDLES.items():
        is_it = F.col("platform") == name
        handle = F.when(is_it, _first_group(u, pats)) if handle is None else handle.when(is_it, _first_group(u, pats))
    low = F.lower(u)
    linkedin = (
        F.when(low.contains("/company/"), "company").when(low.contains("/in/"), "person")
        .when(low.contains("/showcase/"), "page").otherwise("unknown")
    )
    kind = F.when(F.col("platform") == "linkedin", linkedin)
    for name, t in P.PLATFORM_LINK_TYPE.items():
        kind = kind.when(F.col("platform") == name, t)
    return (
        df.withColumn("handle", handle)
        .withColumn("link_type", kind)
        .filter(F.col("handle").isNull() | ~F.lower("handle").isin(*P.GENERIC_HANDLES))
    )


def may_follow(url: Column, linkedin: Column, twitter: Column, facebook: Column) -> Column:
    """Only these three platforms can be followed, each by its own flag."""
    p = social_platform(url)
    allowed = F.when(p == "linkedin", linkedin).when(p == "twitter", twitter).when(p == "facebook", facebook)
    return F.coalesce(allowed, F.lit(False))
