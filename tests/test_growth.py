"""What the smallest tables do not show."""

import functools
import hashlib
import json
import os
import random
import tracemalloc

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitebrief.functions import extract, markup, scalars, text
from sitebrief.operators import dedup
from sitebrief.operators.clusters import greedy_leaders
from sitebrief.plans.registry import Tables
from sitebrief.session import TABLE_SCHEMAS, shared_folder
from sitebrief.sources.briefs import read_json_export, write_json_export
from sitebrief.streaming import live
from tools.check import rows


def test_entities_of_all_types_with_clusters_in_several_steps(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(dedup, "greedy_leaders", functools.partial(greedy_leaders, block=8))
    con = duckdb.connect()
    for t in TABLE_SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ["cluster_sources"]:
        df = entry.queries()[name](spark, sf_dir)
        cur = con.execute(entry.oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["cluster_contexts", "cluster_sources", "entity_merge", "dedup_summary"])
def test_merged_entities_with_clusters_in_several_steps(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(dedup, "greedy_leaders", functools.partial(greedy_leaders, block=32))
    con = duckdb.connect()
    for t in TABLE_SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_generated_code_of_organization_names_compiles(spark, sf_dir):
    orgs = Tables(spark, sf_dir).v_mentions.filter("type = 'org'").withColumn("name", dedup.org_name(F.col("value"))).filter("name IS NOT NULL")
    plan = orgs._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    assert "maxMethodCodeSize:-1" not in plan.explainString(mode)


def test_references_need_their_semicolon():
    page = '<title>a&amp</title><p>b&lt; &copy c &notit; &#233; &eacute;&amp</p><a href="/x?a=1&copy=2&amp;b=3">d</a>'
    assert markup.parts(page) == ("a&amp", "a&amp b< &copy c &notit; é é&amp d", ["/x?a=1&copy=2&b=3"])


def test_report_cost_below_a_tie(spark):
    got = spark.createDataFrame([(1400, 1170), (0, 0), (None, 1)], "i long, o long").select(scalars.report_cost(F.col("i"), F.col("o"))).collect()
    assert [r[0] for r in got] == [round(1400 * 0.000003 + 1170 * 0.000015, 4), 0.0, None] and got[0][0] == 0.0217


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_extract", "stream_mentions", "stream_new_pages"):
        one, many = (entry.queries()[name](spark, d).collect() for d in (sf_dir, str(tmp_path)))
        assert one and sorted(map(str, one)) == sorted(map(str, many))


def test_batches_of_texts_are_read_a_few_at_a_time(spark):
    pages = pa.array([f"<title>{i}</title><p>{'ab ' * 3000}</p><a href='/{i}'>x</a>" for i in range(3000)] + [None, ""])
    texts = pa.array(["Python and AWS. " + "ab " * 3000] * 3000 + [None, ""])
    for run, values in ((text._page_parts.func, pages), (extract.column(lambda t, around: []).func, texts)):
        tracemalloc.start()
        out = run(values)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 3002 and peak < 10_000_000
    assert text._page_parts.func(pages)[2999].as_py()["links"] == ["/2999"] and len(text._page_parts.func(pa.array([], pa.string()))) == 0


class _Handle:
    """State and timers of one job; no timer is ever listed."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def clear(self):
        self.value = None

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_silent_jobs_keep_one_timer_without_listing_them():
    for limit in (None, 10**6):
        handle, rule, got = _Handle(), live.Silence(3600, limit), []
        rule.init(handle)
        batches = [[5, 1, 4000], [9000, 3990, 9001], [9000], [20000]]
        for n, times in enumerate(batches):
            half = [pd.DataFrame({"us": [t * 10**6 for t in x], "event_id": range(len(x)), "control": None}) for x in (times[:1], times[1:]) if x]
            for part in rule.handleInputRows((7,), iter(half), None):
                got += part[["job_id", "us", "kind"]].values.tolist()
            assert handle.timers == {max(max(b) for b in batches[:n + 1]) * 1000 + 3_600_001}
        assert got == [[7, 5 * 10**6, "stale"], [7, 4000 * 10**6, "stale"], [7, 9001 * 10**6, "stale"]]
        assert [p.values.tolist() for p in rule.handleExpiredTimer((7,), None, None)] == [[[7, 20000 * 10**6, "stale"]]]


def test_a_long_document_goes_on_in_the_next_file(spark, tmp_path):
    text = lambda i: f'v{i} ,"\t]}}\n{{"type":'
    docs = spark.createDataFrame([(c, '{"company":{"id":"%s"}}' % c) for c in "abc"], "company_id string, doc string")
    own = [("a", i // 2, text(i)) for i in range(3000)] + [("c", None, text(0)), ("c", 5, text(1)), ("c", 5, text(2))]  # ids come twice, or are missing
    entities = spark.createDataFrame([(c, i, "person", t, 0.5, None, None, None) for c, i, t in own],
                                     "company_id string, entity_id long, entity_type string, entity_value string, confidence double, source_url string, "
                                     "role string, relationship string")
    pages = spark.createDataFrame([("a", i, None if i % 5 == 0 else f"u{i}", "about", True) for i in range(400)],
                                  "company_id string, page_id long, url string, page_type string, is_external boolean")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        write_json_export(docs, str(tmp_path), entities, pages.selectExpr("*", "timestamp'2024-01-02 03:04:05' AS crawled_at"), whole=1000)
        files = [open(tmp_path / "briefs" / f).read() for f in sorted(os.listdir(tmp_path / "briefs")) if f.startswith("part-")]
        got = {json.loads(r["doc"])["company"]["id"]: r[1:] for r in read_json_export(spark, str(tmp_path), lambda e: e["value"], lambda p: p["url"]).collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    whole = {d["company"]["id"]: d for d in map(json.loads, filter(str.strip, "".join(files).split("\n")))}
    assert sum('"v1' in f for f in files) > 1 and sum('"u1' in f for f in files) >= 1
    assert [e["value"] for e in whole["a"]["entities"]] == sum((sorted((text(2 * i), text(2 * i + 1))) for i in range(1500)), [])
    assert [e["value"] for e in whole["c"]["entities"]] == [text(0), text(1), text(2)] and [p["url"] for p in whole["a"]["pages"]][:2] == [None, "u1"]
    md5 = lambda texts: hashlib.md5(",".join(t for t in texts if t is not None).encode()).hexdigest()
    assert got == {c: (len(d["entities"]), md5([e["value"] for e in d["entities"]]), len(d["pages"]), md5([p["url"] for p in d["pages"]])) for c, d in whole.items()}


def test_documents_take_little_disk(spark, tmp_path):
    """Neither plain text nor a second copy of it: what is written, shuffled and checkpointed, against the pieces' size."""
    store, n = spark.sparkContext._jsc.sc().statusStore(), 20_000
    docs = spark.createDataFrame([(c, '{"company":{"id":"%s"}}' % c) for c in "ab"], "company_id string, doc string")
    entities = spark.range(n).selectExpr("IF(id % 3 = 0, 'a', 'b') AS company_id", "id AS entity_id", "'person' AS entity_type", "'Entity ' || id AS entity_value",
                                         "0.5D AS confidence", "'https://p.example.com/' || id % 500 AS source_url", "'Role' AS role", "NULL AS relationship")
    pages = spark.range(n // 4).selectExpr("IF(id % 3 = 0, 'a', 'b') AS company_id", "id AS page_id", "'https://www.example.com/p/' || id AS url",
                                           "'about' AS page_type", "timestamp'2024-01-02 03:04:05' AS crawled_at", "true AS is_external")

    def size(folder):
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)

    def shuffled():
        gateway = spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    folder = shared_folder(spark).removeprefix("file:")
    before, kept = shuffled(), size(folder)
    write_json_export(docs, str(tmp_path), entities, pages, compression="gzip")
    wrote, briefs = shuffled() - before, size(tmp_path / "briefs")
    got = read_json_export(spark, str(tmp_path), lambda e: e["value"], lambda p: p["url"]).collect()
    read = shuffled() - before - wrote
    plain = sum(len(r["doc"]) for r in got) + entities.selectExpr("sum(length(to_json(struct(*))))").first()[0]
    assert sorted((r["n_entities"], r["n_pages"]) for r in got) == [(6667, 1667), (13333, 3333)]
    assert briefs < plain / 8 and wrote < plain / 3 and read < plain / 100 and size(folder) - kept < plain / 100, (plain, briefs, wrote, read, size(folder) - kept)


class _Now:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def _runs(events, end, seconds, limit):
    """One event after the other: silences by their last sign of life, limits by the time they are reached."""
    out, last, spent, paused, over = [], None, 0, False, False
    for t, control in [*events, (end, None)]:
        if last is not None:
            due = last + limit - spent
            if not paused and not over and due < min(t, last + seconds):
                out.append((due, "timeout"))
                over = True
            if t > last + seconds:
                out.append((last, "stale"))
                last = None
        spent, paused, over = (0, False, False) if last is None else (spent + (0 if paused else t - last), paused, over)
        last, paused = t, control == "pause" or paused and control != "resume"
    return sorted(out)


def test_time_limits_run_out_at_their_time_whatever_the_batches():
    rnd, kinds = random.Random(5), set()
    for limit in (3600, 9000):
        for _ in range(60):
            t, events = 0, []
            for _ in range(40):
                t += rnd.choice([1, 600, 1700, 3600, 3601, 9000]) * 10**6 + rnd.randrange(2) * 1000
                events.append((t, rnd.choice([None, None, "pause", "resume"])))
            end = t + rnd.choice([0, 2000, 3000, 3700]) * 10**6 + 500_000
            want = _runs(events, end, 3600 * 10**6, limit * 10**6)
            for size in (40, 7, 1):
                handle, rule, got = _Handle(), live.Silence(3600, limit, ahead=True), []
                rule.init(handle)
                for at in range(0, 40, size):
                    part = events[at:at + size]
                    pdf = pd.DataFrame({"us": [t for t, _ in part], "event_id": range(len(part)), "control": [c for _, c in part]}).sample(frac=1, random_state=1)
                    got += [r for p in rule.handleInputRows((7,), iter([pdf]), None) for r in p[["us", "kind"]].itertuples(index=False, name=None)]
                    now = _Now(end if at + size >= 40 else part[-1][0])
                    while [x for x in handle.timers if x < now.us // 1000]:
                        handle.timers.remove(min(handle.timers))
                        got += [r for p in rule.handleExpiredTimer((7,), now, None) for r in p[["us", "kind"]].itertuples(index=False, name=None)]
                    assert len(handle.timers) == (handle.value is not None)
                assert sorted(got) == want
            kinds |= {k for _, k in want}
    assert kinds == {"stale", "timeout"}


def test_stale_jobs_over_several_files_have_their_time_limits(spark, tmp_path):
    rnd, rows, schema = random.Random(6), [], "job_id long, event_id long, control string, ts timestamp"
    for job in range(6):
        t = 1_700_000_000
        for e in range(80):
            t += rnd.choice([1, 300, 900, 1700, 4000] if job else [1500])
            rows.append((job, job * 100 + e, rnd.choice([None, None, "pause", "resume"]), t))
    df = spark.createDataFrame(rows, "job_id long, event_id long, control string, t long").withColumn("ts", F.timestamp_seconds("t"))
    cuts = sorted(t for *_, t in rows)[::160] + [2 * 10**9]  # files are read in the order in which they were written
    for a, b in zip(cuts, cuts[1:]):
        df.filter(F.col("t").between(a, b - 1)).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_files(spark, str(tmp_path / "in"), schema, "*.parquet", files_per_batch=1)
    got = live.run_to_files(live.silent_jobs(stream, 3600, limit=3600, ahead=True), str(tmp_path / "out")).collect()
    end = (max(t for *_, t in rows) - 600) * 10**6
    want = [(j, *x) for j in range(6) for x in _runs([(t * 10**6, c) for i, _, c, t in sorted(rows) if i == j], end, 3600 * 10**6, 3600 * 10**6)]
    assert sorted(map(tuple, got)) == sorted(want) and {k for *_, k in want} == {"stale", "timeout"}
