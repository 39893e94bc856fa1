"""Windows, merging, rules and streams against brute force on small fixtures."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitebrief.operators import checkpoints
from sitebrief.operators import dedup as D
from sitebrief.operators.checkpoints import checkpoint_points
from sitebrief.operators.clusters import greedy_leaders
from sitebrief.operators import ranking as K
from sitebrief.operators.chunks import running, top
from sitebrief.operators.graph import link_depth
from sitebrief.sources import briefs as B
from sitebrief.sources import robots as R
from sitebrief.sources import sitemaps as M
from sitebrief.session import clear_scratch, scratch_path
from sitebrief.sources.company_csv import CsvHeaderError, read_companies
from sitebrief.streaming import live as V


def test_running_equals_plain_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), i, rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    w = W.partitionBy("k").orderBy("i")
    want = df.select("k", "i", F.row_number().over(w).cast("long"), F.sum("v").over(w), F.lag("v").over(w), F.lead("v").over(w))
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), "n", {"s": F.col("v")}, {"p": F.col("v")}, {"q": F.col("v")})
    assert sorted(map(tuple, want.collect()), key=str) == sorted(
        map(tuple, got.select("k", "i", "n", "s", "p", "q").collect()), key=str)


def test_top_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and top(df, ["k"], [F.col("id")], 5).count() == 15


def fold_checkpoints(times, pages, seconds):
    out, n, last = [], 0, None
    for i, t in enumerate(times):
        last = t if last is None else last
        n += 1
        if n >= pages or t - last >= seconds:
            out.append(i)
            n, last = 0, t
    return out


@pytest.fixture(scope="module")
def log(spark):
    rnd, rows, e = random.Random(2), [], 0
    for job in range(5):
        t = 1_700_000_000.0
        for _ in range([400, 3, 1, 37, 90][job]):
            t += rnd.choice([1, 5, 20, 70, 130])
            rows.append((job, e, t, rnd.choice(["pause", "resume", None])))
            e += 1
    df = spark.createDataFrame(rows, "job_id long, event_id long, t double, control string")
    return rows, df.withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("long"))).drop("t")


@pytest.mark.parametrize("size", [10, 16, 64, 4096])
def test_checkpoint_points(log, size):
    rows, df = log
    want = {(j, [r[1] for r in rows if r[0] == j][i]) for j in range(5)
            for i in fold_checkpoints([r[2] for r in rows if r[0] == j], 10, 120.0)}
    got = {(r[0], r[1]) for r in checkpoint_points(df, 10, 120.0, size=size).collect()}
    assert got == want


def test_checkpoint_points_of_a_hot_job_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "FAN", 3)
    rnd, rows, t = random.Random(4), [], 1_700_000_000.0
    for e in range(1200):  # nine of ten events are of one job
        t += rnd.choice([1, 5, 20, 70, 130])
        rows.append((0 if rnd.random() < 0.9 else rnd.randrange(1, 40), e, t))
    df = spark.createDataFrame(rows, "job_id long, event_id long, t double").withColumn(
        "ts", F.timestamp_micros((F.col("t") * 1000000).cast("long")))
    want = set()
    for job in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == job]
        want |= {(job, mine[i][1], i) for i in fold_checkpoints([r[2] for r in mine], 10, 120.0)}
    assert {tuple(r) for r in checkpoint_points(df, 10, 120.0, size=12).collect()} == want


def test_stream_checkpoints_and_silence_over_several_files(spark, log, tmp_path):
    rows, df = log
    ordered = df.orderBy("ts", "event_id").repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id")
    ordered.write.parquet(str(tmp_path / "in"))
    schema = "job_id long, event_id long, control string, ts timestamp"
    read = lambda: V.read_files(spark, str(tmp_path / "in"), schema, "*.parquet")
    want = {(j, [r[1] for r in rows if r[0] == j][i]) for j in range(5)
            for i in fold_checkpoints([r[2] for r in rows if r[0] == j], 10, 120.0)}
    got = V.run_to_files(V.checkpoints(read(), 10, 120.0), str(tmp_path / "c")).collect()
    assert {(r[0], r[1]) for r in got} == want
    # The longest job runs on; the others fall silent long before its end.
    silent = V.run_to_files(V.silent_jobs(read(), 3600), str(tmp_path / "s")).collect()
    assert {r["job_id"] for r in silent} == {1, 2, 3, 4}
    over = V.run_to_files(V.silent_jobs(read(), 10**6, limit=600), str(tmp_path / "t")).collect()

    def first_timeout(j):
        first, pause, paused = None, None, 0
        for _, _, t, c in [r for r in rows if r[0] == j]:
            first = t if first is None else first
            if c == "pause" and pause is None:
                pause = t
            elif c == "resume" and pause is not None:
                paused, pause = paused + t - pause, None
            if t - first - paused - (t - pause if pause is not None else 0) > 600:
                return round(t * 1e6)

    assert {r["job_id"]: r["us"] for r in over} == {j: first_timeout(j) for j in range(5) if first_timeout(j)}


def test_first_ever_over_restarts_and_late_rows(spark, tmp_path):
    rnd, schema = random.Random(12), "site string, url string, hash string, ts long, event_id long"
    urls, hashes, want, e = set(), set(), set(), 0
    for number in range(4):
        rows = []
        for _ in range(40):  # times of all batches overlap: most rows are late
            rows.append((rnd.choice("ab"), rnd.choice(["u1", "u2", "u3", None, f"v{rnd.randrange(60)}"]), f"h{rnd.randrange(25)}", rnd.randrange(100), e))
            e += 1
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = V.first_ever(stream, str(tmp_path / "run"), [["site", "url"], ["site", "hash"]], ["ts", "event_id"])
        fresh = []
        for r in sorted(rows, key=lambda r: (r[3], r[4])):
            if (r[0], r[1]) not in urls:
                urls.add((r[0], r[1]))
                fresh.append(r)
        for r in fresh:
            if (r[0], r[2]) not in hashes:
                hashes.add((r[0], r[2]))
                want.add(r)
        assert {tuple(r) for r in got.collect()} == want


def greedy(items, match):
    """The sequential rule: longest first, join the first cluster whose leader matches."""
    clusters = []
    for pos, value in sorted(items, key=lambda x: (-len(x[1]), x[0])):
        hit = next((c for c in clusters if match(value, c[0][1])), None)
        clusters.append([(pos, value)]) if hit is None else hit.append((pos, value))
    return {frozenset(p for p, _ in c) for c in clusters}


def names_match(a, b):
    n1, n2 = a.lower().strip(), b.lower().strip()
    if n1 == n2:
        return True
    p1, p2 = [x.rstrip(".") for x in n1.split()], [x.rstrip(".") for x in n2.split()]
    if len(p1) < 2 or len(p2) < 2 or p1[-1] != p2[-1]:
        return False
    f, g = p1[0], p2[0]
    return f == g or (len(f) == 1 and g.startswith(f)) or (len(g) == 1 and f.startswith(g))


def ratio(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            m[i][j] = m[i - 1][j - 1] + 1 if x == y else max(m[i - 1][j], m[i][j - 1])
    return 2.0 * m[-1][-1] / (len(a) + len(b))


def fuzzy(a, b):
    return bool(a) and bool(b) and (a == b or ratio(a, b) >= 0.85)


def mentions(spark, values, kind):
    rows = [("c", i, kind, v, 0.5, f"u{i % 3}", f"x{i % 2}", None, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "company_id string, pos long, type string, value string, confidence double, "
                                       "source_url string, context string, role string, relationship string")


def clusters(df):
    out = {}
    for r in df.select("cluster", "pos").collect():
        out.setdefault(r["cluster"], set()).add(r["pos"])
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_person_clusters(spark, seed):
    rnd = random.Random(seed)
    firsts = ["J", "J.", "John", "Jane", "JOHN A.", "Jo", "M.", "", "Mary Ann", ". "]
    values = [f"{rnd.choice(firsts)} {rnd.choice(['Smith', 'Lee', 'Lee.', ''])}{rnd.choice(['', ' '])}" for _ in range(80)]
    assert clusters(D.cluster_persons(mentions(spark, values, "person"))) == greedy(list(enumerate(values)), names_match)


def test_person_links_lose_no_match(spark):
    rnd = random.Random(7)
    firsts = ["J", "J.", "John", "Jane", "JOHN A.", "Jo", "M.", "", "Mary Ann"]
    values = [f"{rnd.choice(firsts)} {rnd.choice(['Smith', 'Lee', 'Lee.', ''])}{rnd.choice(['', ' '])}" for _ in range(80)]
    rows = D.person_match_links(mentions(spark, values, "person")).collect()
    head = {r["name"]: r["known"] for r in rows if r["how"] == "same"}
    linked = {(r["name"], r["known"]) for r in rows if r["how"] != "same"}
    assert set(head) == set(values) and len(rows) <= 2 * len(head)
    for a in head:
        for b in head:
            pair = (head[a], head[b])
            assert names_match(a, b) == (pair[0] == pair[1] or pair in linked or pair[::-1] in linked)


def test_org_clusters(spark):
    rnd = random.Random(5)
    base = ["Acme", "Acme Robotics", "Globex", "Globexx", "Initech Systems", "Initech System", "Umbrella Group", "IBM", "I"]
    values = [rnd.choice(base) + rnd.choice(["", " Inc.", " LLC", ", Ltd", " Company", " Corporation"]) for _ in range(60)]
    values += ["Zeta Holdings International", "Zeta Holding Internationals", "Q", "QZ Partners"]

    def norm(v):
        return spark.createDataFrame([(v,)], "v string").select(D.org_name(F.col("v"))).first()[0]

    n = {v: norm(v) for v in set(values)}
    match = lambda a, b: n[a] in n[b] or n[b] in n[a] or fuzzy(n[a], n[b])
    assert clusters(D.cluster_orgs(mentions(spark, values, "org"))) == greedy(list(enumerate(values)), match)


def test_fuzzy_clusters_over_several_rounds(spark):
    rnd = random.Random(6)
    letters = "abcd"
    values = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(150)] + ["", ""]
    values += [v[:-1] + "Z" for v in values[:40] if len(v) > 8]
    df = mentions(spark, values, "product").withColumn("name", F.lower("value")).filter("name <> ''")
    names = df.groupBy("company_id", "type", "name").agg(F.min(F.struct(-F.length("value"), "pos")).alias("at"))
    names = names.select("company_id", "type", "name", F.col("at.col1").alias("o1"), F.col("at.pos").alias("o2"))
    small = {(r["name"], r["leader"]) for r in greedy_leaders(names, False, block=8).collect()}
    big = {(r["name"], r["leader"]) for r in greedy_leaders(names, False).collect()}
    assert small == big
    want = greedy(list(enumerate(values)), lambda a, b: fuzzy(a.lower(), b.lower()))
    assert clusters(D.cluster_fuzzy(mentions(spark, values, "product"))) == want


@pytest.mark.parametrize("block", [4, 16])
def test_leaders_by_blocks_equal_the_sequential_rule(spark, block):
    rnd = random.Random(block)
    names = {"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 9))) for _ in range(60)} | {"", "a", "xyz" * 8, "xyz" * 8 + "w"}
    names |= {f"customer {i:04d}" for i in range(40)}  # each is alike many others
    items = [("c", "org", n, -len(n), i) for i, n in enumerate(sorted(names, key=lambda n: hash((n, block))))]
    df = spark.createDataFrame(items, "company_id string, type string, name string, o1 long, o2 long")
    for contain in (False, True):
        match = (lambda a, b: a in b or b in a or fuzzy(a, b)) if contain else fuzzy
        leaders, want = [], set()
        for _, _, n, *_ in sorted(items, key=lambda x: x[3:]):
            hit = next((x for x in leaders if match(n, x)), None)
            leaders += [n] if hit is None else []
            want.add((n, n if hit is None else hit))
        got = greedy_leaders(df, contain, block).select("name", "leader").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(items)


def test_merge_boost_and_missing_confidence(spark):
    m = mentions(spark, ["A@x.io"] * 12 + ["b@x.io"], "email").withColumn(
        "confidence", F.when(F.col("pos") < 12, 0.7)).withColumn("role", F.when(F.col("pos") > 3, F.concat(F.lit("r"), "pos")))
    got = {r["cluster"]: r for r in D.merge(D.cluster_exact(m)).collect()}
    a, b = got["a@x.io"], got["b@x.io"]
    assert round(a["confidence"], 6) == 0.9 and a["mentions"] == 12 and a["n_sources"] == 3 and a["role"] == "r4"
    assert round(b["confidence"], 6) == 0.52


def test_robots(spark):
    text = ("User-agent: *\nDisallow: /a\nAllow: /a\nDisallow: /x*y$\nAllow: /q?\nDisallow: /\n\nUser-agent: SITEBRIEF-BOT\n"
            "Crawl-delay: 0\n")
    robots = spark.createDataFrame([("h.com", text), ("e.com", "")], "domain string, content string")
    urls = ["https://h.com/a", "https://h.com/x1y", "https://h.com/q?z", "https://e.com/a", "https://n.com/a"]
    df = spark.createDataFrame([(u, u.split("/")[2]) for u in urls], "url string, domain string")
    got = {r["url"]: r["allowed"] for r in R.check_urls(df, robots).collect()}
    assert got == dict(zip(urls, [False, False, True, True, True]))


def test_sitemap_limits(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>m{i}</loc></sitemap>" for i in range(9)) + "</sitemapindex>"
    docs = [("r", index)] + [(f"m{i}", f"<urlset><url><loc>u{i}</loc></url><url><loc>v{i}</loc></url></urlset>") for i in range(8)]
    df = spark.createDataFrame(docs, "sitemap_url string, xml string")
    roots = spark.createDataFrame([("r",)], "root string")
    got = [r["url"] for r in M.expand(df, roots, max_files=4, max_urls=5).orderBy("n").collect()]
    assert got == ["u0", "v0", "u1", "v1", "u2"]


def test_link_depth(spark):
    edges = spark.createDataFrame([("s", a, b) for a, b in ["ab", "bc", "ca", "cd", "de", "xy"]], "site string, src string, dst string")
    starts = spark.createDataFrame([("s", "a")], "site string, url string")
    got = {r["url"]: r["depth"] for r in link_depth(edges, starts, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_fair_share_rounds(spark):
    batches = spark.createDataFrame([("p", "processing", 1, 3, 1), ("q", "processing", 1, 2, 0), ("z", "paused", 0, 9, 0)],
                                    "batch_id string, status string, priority int, max_concurrent int, created_at int")
    rows = [(f"p{i}", "p", "pending", i) for i in range(5)] + [(f"q{i}", "q", "pending", i) for i in range(5)]
    rows += [("z0", "z", "pending", 0), ("busy", "p", "in_progress", 0)]
    companies = spark.createDataFrame(rows, "company_id string, batch_id string, status string, created_at int")
    got = [r["company_id"] for r in K.fair_share(companies, batches, 4).orderBy("pick").collect()]
    assert got == ["q0", "p0", "q1"]


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes("﻿company_name,website_url\n\"A, \"\"Inc\"\"\nLine\",a.com\nB,\n".encode())
    got = [tuple(r) for r in read_companies(spark, str(good)).collect()]
    assert got == [('A, "Inc"\nLine', "a.com", ""), ("B", "", "")]
    bad = tmp_path / "bad.csv"
    bad.write_text("name,website_url\nx,y\n")
    with pytest.raises(CsvHeaderError, match="company_name"):
        read_companies(spark, str(bad))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(CsvHeaderError):
        read_companies(spark, str(tmp_path / "empty.csv"))


def test_upsert_keeps_first_time(spark):
    cols = "company_id string, url string, page_type string, crawled_at int, seq int"
    old = spark.createDataFrame([("c", "u", "team", 1, 1)], cols)
    new = spark.createDataFrame([("c", "u", "bulletin", 5, 2), ("c", "v", "news", 6, 3)], cols)
    got = {tuple(r) for r in B.page_upsert(old, new, ["page_type"]).collect()}
    assert got == {("c", "u", "other", 1), ("c", "v", "news", 6)}


def test_scratch_is_cleared(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path != scratch_path(spark, "gone")
    clear_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
