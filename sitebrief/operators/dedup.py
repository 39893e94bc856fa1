"""Merging mentions of the same thing: exact, person names, organization names, fuzzy values.

Mentions have company_id, pos (unique order), type, value, confidence, source_url, context and
one column per extra key. Clustering works on distinct names, never on mentions, and gives for
each name the name that leads its cluster; mentions then join that mapping and are merged by
combining aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions.urls import WS, let, strip
from sitebrief.operators.clusters import greedy_leaders
from sitebrief.session import cut_lineage

EXTRA_KEYS = ["role", "relationship"]


# --- merging ----------------------------------------------------------------------------------

def merge(clustered: DataFrame, extra_keys: list[str] = EXTRA_KEYS) -> DataFrame:
    """One row per (company_id, type, cluster); rows of a cluster are ordered by (o1, o2).

    The value is that of the first most confident row; a missing confidence ranks as 0 and
    counts as 0.5; each mention adds 0.02, at most 0.2. Of extras the first wins. Source and
    context lists have no bound, so they are rows of ``cluster_sources``; here are their counts
    (Spark counts distinct values by cluster and value first, so a large cluster is spread).
    """
    at = F.struct("o1", "o2")
    best = F.max_by(
        F.struct("value", "confidence"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("o1"), -F.col("o2")))
    extras = [F.min_by(k, F.when(F.col(k).isNotNull(), at)).alias(k) for k in extra_keys]
    sets = [F.array_join(F.array_sort(F.collect_set(k)), ",").alias(f"{k}s") for k in extra_keys]
    df = clustered.withColumn("source_url", F.nullif("source_url", F.lit(""))).withColumn(
        "context", F.nullif("context", F.lit("")))
    out = df.groupBy("company_id", "type", "cluster").agg(
        best.alias("_b"), F.count("*").alias("mentions"), F.min("source_url").alias("source_url"),
        F.min("context").alias("context"), F.count_distinct("source_url").alias("n_sources"),
        F.count_distinct("context").alias("n_contexts"), *extras, *sets)
    conf = F.least(F.lit(1.0), F.coalesce("_b.confidence", F.lit(0.5)) + F.least(F.lit(0.2), F.col("mentions") * 0.02))
    return out.withColumn("value", F.col("_b.value")).withColumn("confidence", conf).drop("_b")


def cluster_sources(clustered: DataFrame) -> DataFrame:
    """All sources of each cluster, one row each."""
    return clustered.filter(F.coalesce("source_url", F.lit("")) != "").select(
        "company_id", "type", "cluster", "source_url").distinct()


def cluster_contexts(clustered: DataFrame) -> DataFrame:
    """All contexts of each cluster, one row each."""
    return clustered.filter(F.coalesce("context", F.lit("")) != "").select(
        "company_id", "type", "cluster", "context").distinct()


# --- exact ------------------------------------------------------------------------------------

def exact_key(kind: Column, value: Column) -> Column:
    v = strip(F.lower(value))
    return F.when(kind == "phone", F.regexp_replace(v, r"\D", "")).otherwise(v)


def cluster_exact(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("cluster", exact_key(F.col("type"), F.col("value"))).withColumn(
        "o1", F.lit(0)).withColumn("o2", F.col("pos"))


# --- persons ----------------------------------------------------------------------------------

def with_name_parts(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds first and last (dots at their ends dropped); a name of one part is its own last part."""
    n = strip(F.lower(F.col(value)))
    parts = F.transform(F.filter(F.split(n, f"{WS}+"), lambda p: p != ""), lambda p: F.regexp_replace(p, r"\.+$", ""))
    df = df.withColumn("_n", n).withColumn("_parts", parts)
    many = F.size("_parts") >= 2
    return (
        df.withColumn("multi", many)
        .withColumn("first", F.when(many, F.get("_parts", F.lit(0))).otherwise(F.lit("")))
        .withColumn("last", F.when(many, F.element_at("_parts", -1)).otherwise(F.col("_n")))
        .drop("_n", "_parts")
    )


def person_match_links(mentions: DataFrame) -> DataFrame:
    """All matches among all names, as links: (company_id, name, known, how).

    ``same``: each name with the first name (longest, then by pos) of its class, which has the same first and last part.
    ``known is initial``: the first name of a full class with that of its initial's class. Two names match exactly if
    their classes are one or linked, so the rows are at most two per name and no match is lost.
    """
    key = ["company_id", "multi", "last", "first"]
    df = with_name_parts(mentions)
    names = df.select(*key, F.col("value").alias("name")).distinct()
    heads = df.groupBy(*key).agg(F.min_by("value", F.struct(-F.length("value"), "pos")).alias("known"))
    same = names.join(heads, key).select("company_id", "name", "known", F.lit("same").alias("how"))
    at = ["company_id", "last", F.substring("first", 1, 1).alias("letter")]
    heads = heads.filter("multi")
    full = heads.filter(F.length("first") > 1).select(*at, F.col("known").alias("name"))
    initial = heads.filter(F.length("first") == 1).select(*at, "known")
    return same.unionByName(full.join(initial, ["company_id", "last", "letter"]).select(
        "company_id", "name", "known", F.lit("known is initial").alias("how")))


def cluster_persons(mentions: DataFrame) -> DataFrame:
    """Greedy clusters of names, longest first, in closed form.

    Whether names match depends only on their first and last part, so all names with the same
    two parts fall in one cluster, and inside one last part and first letter the only names
    that can meet are full first names and the bare initial. If the initial comes first it leads
    them all; otherwise each full first name leads its own and the initial joins the first.
    """
    df = with_name_parts(mentions).withColumn("o1", -F.length("value")).withColumn("o2", F.col("pos"))
    key = ["company_id", "multi", "last", "first"]
    names = df.groupBy(*key).agg(F.min(F.struct("o1", "o2", "value")).alias("at"))
    names = names.withColumn("letter", F.substring("first", 1, 1)).withColumn(
        "initial", F.col("multi") & (F.length("first") == 1))
    heads = names.groupBy("company_id", "multi", "last", "letter").agg(F.min(F.struct("at", "initial")).alias("head"))
    j = names.join(heads, ["company_id", "multi", "last", "letter"])
    lead = F.when(F.col("head.initial") | F.col("initial"), F.col("head.at")).otherwise(F.col("at"))
    mapping = j.select(*key, lead["value"].alias("canonical"), lead["o2"].cast("string").alias("cluster"))
    return df.join(mapping, key).drop("multi", "first", "last")


# --- organizations and other values -----------------------------------------------------------

def org_name(value: Column) -> Column:
    """Lower case, legal forms dropped from the end, punctuation dropped, single spaces."""
    # strip reads its argument several times; written out, the code of a stage would pass 64 KB.
    n = let(F.lower(value), strip)
    for suffix in P.LEGAL_SUFFIXES:
        n = F.regexp_replace(n, suffix.replace(r"\s", WS), "")
    n = F.regexp_replace(n, r"[^\p{L}\p{N}_" + WS[1:-1] + "]", "")
    return let(F.regexp_replace(n, f"{WS}+", " "), strip)


def _cluster_greedy(df: DataFrame, contain: bool) -> DataFrame:
    """df has name (the form compared), value, pos, o1, o2."""
    key = ["company_id", "type", "name"]
    # Read three times; normalizing names is not repeated.
    first = cut_lineage(df.groupBy(*key).agg(F.min(F.struct("o1", "o2", "value")).alias("at")))
    names = first.select(*key, F.col("at.o1").alias("o1"), F.col("at.o2").alias("o2"))
    leaders = greedy_leaders(names, contain)
    titles = first.select("company_id", "type", F.col("name").alias("leader"), F.col("at.value").alias("canonical"),
                          F.col("at.o2").cast("string").alias("cluster"))
    mapping = leaders.join(titles, ["company_id", "type", "leader"]).drop("leader")
    return df.join(mapping, key).drop("name")


def cluster_orgs(mentions: DataFrame) -> DataFrame:
    """Organizations: normalized names equal, one inside the other, or alike. An empty name joins any."""
    df = mentions.withColumn("name", org_name(F.col("value"))).withColumn("o1", -F.length("value")).withColumn(
        "o2", F.col("pos"))
    return _cluster_greedy(df, contain=True)


def cluster_fuzzy(mentions: DataFrame) -> DataFrame:
    """Other values: alike in lower case. Empty values never merge, not even with each other."""
    df = mentions.withColumn("name", F.lower("value")).withColumn("o1", -F.length("value")).withColumn("o2", F.col("pos"))
    empty = df.filter("name = ''").withColumn("canonical", F.lit("")).withColumn("cluster", F.col("pos").cast("string"))
    return _cluster_greedy(df.filter("name <> ''"), contain=False).unionByName(empty.drop("name"))


def cluster_all(mentions: DataFrame) -> DataFrame:
    """Each type by its own rule."""
    t = F.col("type")
    exact = cluster_exact(mentions.filter(t.isin("email", "phone")))
    exact = exact.withColumn("canonical", F.col("cluster"))
    persons = cluster_persons(mentions.filter(t == "person"))
    orgs = cluster_orgs(mentions.filter(t == "org"))
    rest = cluster_fuzzy(mentions.filter(~t.isin("email", "phone", "person", "org")))
    return exact.unionByName(persons).unionByName(orgs).unionByName(rest)


def summary(mentions: DataFrame, merged: DataFrame) -> DataFrame:
    before = mentions.groupBy("company_id").agg(F.count("*").alias("original_count"))
    after = merged.groupBy("company_id").agg(F.count("*").alias("deduplicated_count"))
    j = before.join(after, "company_id", "left").fillna(0)
    return j.withColumn("removed", F.col("original_count") - F.col("deduplicated_count"))
