"""Guess cost against all segmentations; precision and recall on planted values; op5's check on odd line ends."""

import functools
import math
import random

import duckdb

from sitebrief.llm import queries, quality, secret_scan
from sitebrief.llm.common import documents

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def brute(value, words):
    low, rank, touch = value.lower(), {}, secret_scan.keyboard_neighbours()
    for w in words:
        rank.setdefault(w, len(rank) + 1)
    plain = low.translate(secret_scan.LEET)
    steps = [ord(b) - ord(a) for a, b in zip(low, low[1:])]

    @functools.lru_cache(None)
    def least(end):
        if end == 0:
            return 0.0
        c = value[end - 1]
        char = 2.0 if c in "_-." else math.log2(26 if c.isalpha() else 10 if c.isdigit() else 33)
        costs = [least(end - 1) + char]
        for start in range(end):
            part, size = low[start:end], end - start
            for form, extra in ((part, 0), (plain[start:end], 1)):
                if form in rank and size > 1:
                    v = value[start:end]
                    costs.append(least(start) + math.log2(rank[form]) + 1 + extra + (0 if v.islower() else 1 if v[1:].islower() else 2))
            inner = steps[start:end - 1]
            if size >= 3:
                if set(inner) == {0}:
                    costs.append(least(start) + char + math.log2(size))
                if set(inner) in ({1}, {-1}):
                    costs.append(least(start) + char + 1 + math.log2(size))
                if all(p in touch for p in zip(part, part[1:])):
                    costs.append(least(start) + char + 2 + math.log2(size))
            m = secret_scan._DATE.match(low, start)
            if m and m.end() == end:
                costs.append(least(start) + secret_scan.DATE_BITS[size > 4])
            for block in range(2, 17):
                if size >= block and start >= block and all(low[i] == low[i - block] for i in range(start, end)):
                    costs.append(least(start) + 1 + math.log2(1 + size / block))
        return min(costs)

    return least(len(value))


def test_cost_is_the_least_over_all_segmentations():
    rnd, words = random.Random(6), secret_scan.WORDS
    cost = secret_scan.GuessCost(words)
    parts = [*words[:20], "aaaa", "sss", "1234", "9876", "qwer", "asdf", "2019", "19991231", "abab", "x", "7", "#", "-", "P", "0", "$"]
    for _ in range(400):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6)))[:22]
        value = "".join(c.upper() if rnd.random() < 0.1 else c for c in value)
        assert math.isclose(cost(value), brute(value, words), abs_tol=1e-9), value


SECRETS = ["kT9#vQ2!mZ4p", "x7Lq9-Rt2w_Vb5", "Zp4$gh8KwQ1z", "9f$Kd02jsLQ77xa", "Tr0ub4dor&3xQz!9", "hV6:pL2:wN8:cX4", "q8W(e7R)t6Y!u5I", "AbX93kdPq02LmZ"]
HARMLESS = ["https://example.com/account/reset", "authentication/authorization", "nineteenth-century/Victorian", "${VAULT_DATABASE_PASSWORD}",
            "$DB_PASSWORD", "<your-password-here>", "your-database-password-goes-here", "/etc/app/secrets/token.txt", "./config/password.yml",
            "{{ vault.password }}", "%(db_password)s", "os.environ['TOKEN']", "process.env.API_KEY", "changeme123", "password1234", "********", "qwerty12345"]


def test_precision_and_recall_of_planted_values():
    cost, rnd = secret_scan.GuessCost(), random.Random(1)
    frames = ["Set the password {} now.", "api_key = '{}'", "token: {}", "The secret is {}", "export DB_PASSWORD=\"{}\""]
    hit = lambda text: bool(secret_scan.guess_spans(text, cost, 40.0, []))
    found = [hit(rnd.choice(frames).format(v)) for v in SECRETS for _ in range(3)]
    wrong = [v for v in HARMLESS for f in frames if hit(f.format(v))]
    assert all(found) and not wrong
    assert hit("url: https://x password=https://bob:kT9vQ2mZ4pLx7@db.example.com/x")


def test_words_of_the_table_are_ranked(spark):
    rows = [(i, "The rendezvous, of (serendipity) kT9vQ2mZ; zyzzyvaword", None, None, 1) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, "rareword", None, None, 1), (None, None, None, None, None)], DDL)
    words = secret_scan.ranked_words(df)
    assert words[:len(secret_scan.WORDS)] == secret_scan.WORDS or list(words[:len(secret_scan.WORDS)]) == list(secret_scan.WORDS)
    assert {"rendezvous", "serendipity", "zyzzyvaword"} <= set(words) and "rareword" not in words
    assert secret_scan.scan_secrets(df.limit(0)).collect() == [] and secret_scan.redact(df.limit(0)).collect() == []


def test_quality_check_agrees_on_odd_line_ends(spark, tmp_path):
    line = "This is a plain sentence with more than ten words in it, as prose has."
    texts = ["\r\n".join([line, "Home | About | Contact", "a heading of exactly ten words that has no end", line] * 4), "a\x0bb\x0cc\td " * 30,
             (line + " \r\n") * 8, "\r\n\r\n", None, "x\x0b\n\x0b\nx\r\n" * 20]
    rows = [(i % 5, t, None, None, 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None, 1)]
    df = spark.createDataFrame(rows, DDL).coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries.OP5)
    names = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert documents(spark, str(tmp_path)).count() == 7 and quality.quality_table(df.limit(0)).count() == 0
