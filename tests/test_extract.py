"""Extraction against a plain Python scan of the same patterns over whole documents."""

import random
import re
import time

from pyspark.sql import functions as F

from sitebrief.functions import extract as E
from sitebrief.functions import patterns as P
from sitebrief.functions import sql_functions
from sitebrief.functions.text import snippet
from sitebrief.plans.registry import Tables


def plain_scan(text):
    """Types and keys in order, by Python's own regex engine.

    Addresses are left to the small texts below: plain scanning takes cubic time on long ones.
    """
    out, seen = [], set()
    for m in re.finditer(P.EMAIL, text, re.I):
        seen.add(m.group().lower()) or out.append(("email", m.group().lower())) if m.group().lower() not in seen else None
    for m in re.finditer(P.EMAIL_HIDDEN, text, re.I):
        key = "{}@{}.{}".format(*m.groups()).lower()
        if key not in seen:
            seen.add(key)
            out.append(("email", key))

    def ok(kind, v):
        if kind != "email":
            return True
        local, domain = v.rsplit("@", 1)
        return (domain not in P.PLACEHOLDER_DOMAINS and not domain.endswith((".png", ".jpg")) and "." in domain
                and local and len(domain) >= 3)

    out = [x for x in out if ok(*x)]
    seen = set()
    for i, p in enumerate(P.PHONES):
        for m in re.finditer(p, text):
            key = "+1" + "".join(m.groups()[:3])
            if key not in seen:
                seen.add(key)
                out.append(("phone", key))
    seen = set()
    for platform, pats in P.SOCIAL_IN_TEXT.items():
        for p in pats:
            for m in re.finditer(p, text):
                h = m.group(1).strip("/@")
                if h.lower() not in P.SOCIAL_TEXT_SKIP and (platform, h.lower()) not in seen:
                    seen.add((platform, h.lower()))
                    out.append(("social_handle", h))
    return out


def test_against_plain_scan(spark, sf_dir):
    docs = Tables(spark, sf_dir).v_texts.select("page_id", "text")
    got = {}
    for r in E.entities(docs).filter("type <> 'address'").select("page_id", "pos", "type", "normalized").collect():
        got.setdefault(r["page_id"], []).append((r["pos"], r["type"], r["normalized"]))
    for row in docs.collect():
        want = plain_scan(row["text"])
        assert [(t, n) for _, t, n in sorted(got.get(row["page_id"], []))] == want, row["page_id"]


def test_addresses_in_hard_texts():
    texts = [
        "x SW1 2AA", "one two SW1 2AA three four EC1 3BB five", "a, b, SW1 2AA, c, d, e, EC1 3BB", "SW1 2AA",
        "ab, SW1 2AA", "a,SW1 2AA", "1 Main Street, Suite 5, Town, IL 62701 and 2  Street", "Springfield, IL 62701-1234 x",
        "9 a b c. 7 Elm Road", "é, Ü ß, W1 1AA", "w " * 20 + "W1 1AA " + "z " * 20,
    ]
    for text in texts:
        want = [m.group() for p in P.ADDRESSES for m in re.finditer(p, text)]
        assert [m.group() for m in E.address_matches(text)] == want, text


def test_long_text_without_a_match_is_quick(spark):
    df = spark.createDataFrame([("1 " + "word " * 40_000 + "W1 1AA " + "tail " * 40_000,)], "text string")
    assert E.entities(df).filter("type = 'address'").count() == 2  # "Rd" ends "word"


def test_time_is_linear_in_matches():
    def seconds(n):
        text = " ".join(f"write to user{i}@mail{i}.example.org or call 415-555-{i % 10000:04d}, thanks" for i in range(n))
        start = time.perf_counter()
        found = sum(len(scan(text, E.Contexts(text))) for scan in (E.scan_emails, E.scan_phones, E.scan_addresses, E.scan_handles, E.scan_tech))
        assert found >= n
        return time.perf_counter() - start

    seconds(100)
    one, two = min(seconds(10_000) for _ in range(2)), min(seconds(20_000) for _ in range(2))
    assert two < 3 * one + 0.5 and two < 30


def test_contexts_equal_the_column(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(60):
        text = "".join(rnd.choice("ab c\n\té") for _ in range(rnd.randint(1, 400)))
        s = rnd.randrange(len(text))
        rows.append((text, s, rnd.randint(s, len(text))))
    df = spark.createDataFrame(rows, "t string, s int, e int")
    got = df.select("t", "s", "e", snippet(F.col("t"), F.col("s"), F.col("e")).alias("c")).collect()
    assert all(r["c"] == E.Contexts(r["t"])(r["s"], r["e"]) for r in got)


def test_technology_quirks(spark):
    df = spark.createDataFrame([("C++ and C# here, but C++x; JavaScript, Java Script, java. Git GitHub",)], "text string")
    got = {r["normalized"]: r["extra"]["mentions"] for r in E.explode_entities(E.with_tech_stack(df), "tech", []).collect()}
    assert got == {"c++": "1", "javascript": "1", "java": "1", "git": "1"}


def test_context_and_extension(spark):
    df = spark.createDataFrame([("Call 415-555-2671 now",)], "text string")
    r = E.entities(df).collect()[0]
    assert (r["value"], r["normalized"], r["context"]) == (" 415-555-2671", "+14155552671", "Call 415-555-2671 now")


def test_sql_functions(spark):
    sql_functions.register(spark)
    texts = ["a@b.io x c@d.org or me [at] e [dot] net, +1 (415) 555-2671", "Visit 12 Main Street, Suite 5 today", "Town, IL 62701 x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT i, e.type, e.normalized, e.context FROM sql_texts LATERAL VIEW inline(entities_in(text)) e").collect()
    want = E.entities(df).select("i", "type", "normalized", "context").collect()
    assert got == want and {r["type"] for r in got} >= {"email", "phone", "address"}
    one = spark.sql("SELECT e.value FROM VALUES ('a@b.io x c@d.org') t(x) LATERAL VIEW inline(emails_in(x)) e").collect()
    assert [r[0] for r in one] == ["a@b.io", "c@d.org"]
