"""Column functions against values worked out by hand and against the standard library."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sitebrief.functions import classify as C
from sitebrief.functions import mentions as M
from sitebrief.functions import scalars as S
from sitebrief.functions import text as X
from sitebrief.functions import urls as U


def one(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.select("i", fn.alias("y")).orderBy("i").select("y").collect()]


def test_canonical(spark):
    cases = {
        "HTTP://Ex.COM/A/?b=2&a=1&a=3#f": "http://ex.com/A?a=1&b=2",
        "https://e.com": "https://e.com/",
        "https://e.com///": "https://e.com",
        "https://e.com/?UTM_Source=x&ref=1": "https://e.com/",
        "https://e.com/p?q=a%20b+c&bad=%zz&k": "https://e.com/p?bad=%zz&k=&q=a b c",
        "https://e.com/p;v=1/q;w=2?x=": "https://e.com/p;v=1/q?x=",
    }
    assert one(spark, list(cases), U.canonical(F.col("x"))) == list(cases.values())


def test_crawl_form_keeps_its_quirks(spark):
    cases = {"http://H.com:8080/a/?q=1": "http://h.com80/a", "https://h.com:443/": "https://h.com/",
             "ftp://h/x": None, "//h/x": None, "http:///x": None}
    got = one(spark, list(cases), U.crawl_form(F.col("x")))
    assert got == list(cases.values())


def test_links_resolve_like_the_standard_library(spark):
    bases = ["https://h.com/a/b", "https://h.com/a/b/", "http://h.com", "https://h.com/a/../b/c?x#y"]
    hrefs = ["c", "./c", "../c", "../../../c", "/x/../y", "/..", "/a/./b/", "a//b", "//o.com/z", "?q=1", "c/..", "..",
             "https:d", "HTTPS://O.com/A/../B", "x/y/./../z/", ".", "/a//b/../c"]
    cases = [(b, h) for b in bases for h in hrefs]

    def want(b, h):
        u = urlparse(urljoin(b, h))
        if not u.netloc:
            return None
        path = u.path or "/"
        path = path.rstrip("/") if len(path) > 1 else path
        return f"{u.scheme}://{u.netloc.lower()}{path}"

    got = one(spark, cases, U.link_resolve(F.col("b"), F.col("h")), "b string, h string")
    assert dict(zip(cases, got)) == {c: want(*c) for c in cases}
    assert one(spark, [("http://h", x) for x in ("", "#a", "mailto:a@b", "data:x", "tel:1", "javascript:0")],
               U.link_resolve(F.col("b"), F.col("h")), "b string, h string") == [None] * 6


def test_format_errors(spark):
    got = one(spark, ["", "example.com", "https://x", "http://localhost:3", "http://1.2.3.4/a b"], U.format_error(F.col("x")))
    assert got == ["URL is required", None, "Invalid URL format: https://x", None, "Invalid URL format: http://1.2.3.4/a b"]


def test_text_of_a_page(spark):
    html = ("<!DOCTYPE html><html><head><title> A &amp; B </title><script>var t='</p>';</script></head><body><!-- no -->"
            "<p>One<b> two</p>three &lt;x&gt;<noscript>no</noscript>\n<style>p{}</style></body></html>")
    assert one(spark, [html], X.visible_text(F.col("x"))) == ["A & B One two three <x>"]
    assert one(spark, [html], X.title(F.col("x"))) == ["A & B"]


class _Nodes(HTMLParser):
    """The text nodes by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.nodes = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")
        self.nodes.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript")
        self.nodes.append("")

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_decl(self, decl):
        self.nodes.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.nodes.append(self.nodes.pop() + data if self.nodes else data)


def test_page_text_equals_a_parser(spark, sf_dir):
    odd = ["a &copy;&middot; b &#8217;&#233;&#x1F600; &hellip; &notin; &amp;lt;", "1 < 2 and <b>3</b> > 2", "x<script>var a = '<p>'",
           "<p>a</p><style>b", "<i>a</i>b<!-- c --><br/>d", "", "no tags", "<a href='?a=1&amp;b=2'>t</a><noscript>n</noscript>u"]
    pages = [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    got = one(spark, odd + pages, X.visible_text(F.col("x")))
    for html, text in zip(odd + pages, got):
        parser = _Nodes()
        parser.feed(html)
        parser.close()
        assert text == " ".join(t for t in (n.strip() for n in parser.nodes) if t), html
    assert not any(re.search("&(copy|middot|#)", t) for t in got[len(odd):])
    assert one(spark, [odd[-1]], X.anchor_hrefs(F.col("x"))) == [["?a=1&b=2"]]
    assert one(spark, ["<title>A&nbsp;&#8217;b</title>"], X.title(F.col("x"))) == ["A\u00a0\u2019b"]


def test_hash_ignores_case_and_space(spark):
    a, b = one(spark, ["  Hello\t\nWORLD\xa0", "hello world"], X.content_hash(F.col("x")))
    assert a == b and len(a) == 16


def test_strip_matches_python(spark):
    values = ["", " ", "\xa0a\x1c", "a b", "　x ", "\x85y", "z\n", "é "]
    assert one(spark, values, U.strip(F.col("x"))) == [v.strip() for v in values]


def test_snippet(spark):
    text = ("word " * 30) + "HIT" + (" tail" * 30)
    s = text.index("HIT")

    def want(t, s, e):
        l, r = max(0, s - 50), min(len(t), e + 50)
        while l > 0 and t[l - 1] not in " \n\t":
            l -= 1
        while r < len(t) and t[r] not in " \n\t":
            r += 1
        return (("..." if l > 0 else "") + t[l:r] + ("..." if r < len(t) else "")).strip()

    cases = [(text, s, s + 3), (text, 0, 4), (text, len(text) - 4, len(text)), ("x", 0, 1), ("a" * 200, 100, 101)]
    got = one(spark, cases, X.snippet(F.col("t"), F.col("s"), F.col("e")), "t string, s int, e int")
    assert got == [want(*c) for c in cases]


def test_page_types(spark):
    got = one(spark, ["https://a/teammates", "https://a/About-Us", "https://a/x"], C.page_type_first_match(F.col("x")))
    assert got == ["team", "about", "other"]
    df = spark.createDataFrame([("https://a/blog/our-team", "Our team. Our team."), ("https://a/z", "")], "url string, text string")
    rows = C.with_page_type(df).select("page_type", "match_source", F.round("confidence", 3)).collect()
    assert [tuple(r) for r in rows] == [("team", "combined", 0.827), ("other", "default", 0.5)]


def test_mention_scores(spark):
    got = one(spark, ["Jane Q. Public", "IBMX", "x", "paris"], F.round(M.confidence(F.col("x")), 2))
    assert got == [0.9, 0.7, 0.4, 0.7]
    assert one(spark, ["she will lead the team", "the CEO and Founder", "none"], M.role(F.col("x"))) == ["Lead", "CEO", None]


def test_answer_sources(spark):
    many = "SOURCES: " + " ".join(f"https://s/{i}" for i in range(12))
    got = one(spark, [many, "Sources: https://x", "a"], F.size(M.answer_sources(F.col("x"), 10)))
    assert got == [10, 0, 0]


def test_render_fills_once(spark):
    c = M.render("Hi {a}, {b}!", {"a": F.col("x"), "b": F.lit("{a}")})
    assert one(spark, ["Bo"], c) == ["Hi Bo, {a}!"]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "Acme Corp paid $5 million")], "id int, text string")
    got = M.mention_extract(df, lambda texts: [[(0, 9, "ORG"), (10, 14, "CARDINAL")] for _ in texts]).collect()
    assert [(r["type"], r["value"]) for r in got] == [("org", "Acme Corp")]
    out = M.answers(df.withColumnRenamed("text", "prompt"), lambda ps: [p.upper() for p in ps]).collect()
    assert out[0]["answer"] == "ACME CORP PAID $5 MILLION"


def test_lastmod(spark):
    c = F.date_format(S.lastmod(F.col("x")), "yyyy-MM-dd HH:mm:ss")
    got = one(spark, ["2024-01-05", "2024-01-05T10:00:00+0200", "20240105", "2024-13-01", "soon", "2024"], c)
    assert got == ["2024-01-05 00:00:00", "2024-01-05 08:00:00", "2024-01-05 00:00:00", None, None, None]


def test_names(spark):
    long = "a" * 210 + ".markdown"
    got = one(spark, ["", "a/b\\c\"'.txt", long, "   "], X.safe_name(F.col("x")))
    assert got == ["download", "a_b_c.txt", "a" * 195 + ".mark", "download"]


def test_blocked(spark):
    got = one(spark, ["http://110.1.1.1/", "https://x.internal", "ftp://a", "https://ok.com"], U.blocked_reason(F.col("x")).isNull())
    assert got == [False, False, False, True]
    assert re.search(U.BLOCKED_NETWORK, "http://110.1.1.1/")
