"""robots.txt texts as rule tables. One text is one row; parsing needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions.extract import explode_rows
from sitebrief.functions.urls import robots_path, strip

AGENT = "sitebrief-bot"


def with_rules(df: DataFrame, agent: str = AGENT, content: str = "content") -> DataFrame:
    """Adds rules (array<struct<kind, pattern>>), crawl_delay and sitemaps to each text row.

    The rules of our agent count if it has any rule or a delay that is not zero, else those of ``*``.
    """
    me = agent.lower()
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: strip(F.substring_index(x, "#", 1)))
    pairs = F.transform(
        F.filter(lines, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.lower(strip(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"),
            strip(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )
    start = F.struct(
        F.lit("").alias("agent"),
        F.array().cast("array<struct<agent:string,kind:string,pattern:string>>").alias("rules"),
        F.create_map().cast("map<string,double>").alias("delays"),
    )

    def step(acc, p):
        is_rule = p["key"].isin("allow", "disallow") & (acc["agent"] != "") & (p["value"] != "")
        delay = F.when((p["key"] == "crawl-delay") & (acc["agent"] != ""), p["value"].try_cast("double"))
        rule = F.struct(acc["agent"].alias("agent"), p["key"].alias("kind"), p["value"].alias("pattern"))
        named = F.when(F.lower(p["value"]).isin("*", me), F.lower(p["value"])).otherwise("")
        others = F.map_filter(acc["delays"], lambda k, v: k != acc["agent"])
        return F.struct(
            F.when(p["key"] == "user-agent", named).otherwise(acc["agent"]).alias("agent"),
            F.when(is_rule, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]).alias("rules"),
            F.when(delay.isNotNull(), F.map_concat(others, F.create_map(acc["agent"], delay)))
            .otherwise(acc["delays"]).alias("delays"),
        )

    df = df.withColumn("_pairs", pairs).withColumn("_all", F.aggregate("_pairs", start, step))
    mine = F.exists("_all.rules", lambda r: r["agent"] == me) | (
        F.coalesce(F.try_element_at("_all.delays", F.lit(me)), F.lit(0.0)) != 0)
    df = df.withColumn("agent", F.when(mine, me).otherwise("*"))
    kept = F.filter("_all.rules", lambda r: r["agent"] == F.col("agent"))
    maps = F.filter("_pairs", lambda p: (p["key"] == "sitemap") & (
        p["value"].startswith("http://") | p["value"].startswith("https://")))
    return (
        df.withColumn("rules", F.transform(kept, lambda r: F.struct(r["kind"].alias("kind"), r["pattern"].alias("pattern"))))
        .withColumn("crawl_delay", F.try_element_at("_all.delays", F.col("agent")))
        .withColumn("sitemaps", F.transform(maps, lambda p: p["value"]))
        .drop("_pairs", "_all")
    )


def rules_table(df: DataFrame, agent: str = AGENT) -> DataFrame:
    """(domain, agent, kind, pattern, crawl_delay): one row per rule and per sitemap."""
    df = with_rules(df, agent)
    maps = F.transform("sitemaps", lambda s: F.struct(F.lit("sitemap").alias("kind"), s.alias("pattern")))
    rows = explode_rows(df.withColumn("_rows", F.concat("rules", maps)), "_rows",
                        ["domain", "agent", "crawl_delay"])
    return rows.select("domain", "agent", "crawl_delay", F.col("_pos").cast("bigint").alias("pos"), "_col.*")


def _matches(path: Column, pattern: Column) -> Column:
    """Prefix match with ``*`` and a final ``$``. Plain prefixes, the usual case, need no regex."""
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([\\.\[\](){}+?^|$])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), escaped, F.when(pattern.endswith("$"), F.lit("$")).otherwise(""))
    return F.when(pattern.contains("*") | pattern.endswith("$"), F.rlike(path, regex)).otherwise(
        path.startswith(pattern))


def allowed(path: Column, rules: Column) -> Column:
    """The longest matching rule decides; at equal length Disallow wins; no match is allowed."""
    hits = F.filter(rules, lambda r: _matches(path, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(
        F.length(r["pattern"]).alias("n"), (r["kind"] == "disallow").alias("no"))))
    return ~F.coalesce(best["no"], F.lit(False))


def check_urls(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """URLs (with a domain column) with allowed and the crawl delay of their domain.

    The rules of a domain travel as one array in one row, so a URL meets exactly one row and
    nothing has to be grouped again. The engine broadcasts the rules when it finds them small;
    when not, a domain with very many URLs is split by the skew handling of the join.
    """
    rules = with_rules(robots, agent).select("domain", "rules", "crawl_delay")
    j = urls.join(rules, "domain", "left").withColumn("_path", robots_path(F.col("url")))
    ok = F.coalesce(allowed(F.col("_path"), F.col("rules")), F.lit(True))
    return j.withColumn("allowed", ok).drop("_path", "rules")


def effective_delay(crawl_delay: Column, per_second: float = 1.0) -> Column:
    return F.greatest(F.coalesce(crawl_delay, F.lit(0.0)), F.lit(1.0 / per_second))
