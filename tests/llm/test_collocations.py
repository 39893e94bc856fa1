"""Collocations against counting all phrases in memory."""

import random
import re
from collections import Counter

from sitebrief.llm import collocations as C

DDL = "doc_id long, text string, lang string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, share, limit):
    out, f, total = [], Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    around = Counter()
    for (lang, p), a in frequent.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                around[lang, q] = max(around[lang, q], a)
    for lang in total:
        rows = []
        for (at, p), a in frequent.items():
            if at == lang and not (around[at, p] and 100 * around[at, p] >= share * a):
                cuts = [(1_000_000 * a * a // (f[at, p[:k]] * f[at, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p), f[at, p[:k]], f[at, p[k:]]))
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, i + 1, p, -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:limit])]
    return sorted(out)


def got(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", phrase string, shard int")
    return sorted(tuple(r) for r in C.collocations(df, **args).collect())


def test_random_texts(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["the", "The", "of", "é", "漢字", "new", "york", "times", "a" * 60, "A" * 60, "a" * 59 + "b"]
    for window in (1 << 21, 40):
        monkeypatch.setattr(C, "WINDOW", window)
        rows = []
        for i in range(120):
            text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " - "]) for _ in range(rnd.randrange(60)))
            rows.append((i, rnd.choice(["", " "]) + text, rnd.choice(["en", "en", "fr", None, "und", ""])))
        rows += [(1, None, "en"), (None, "new york times new york times", "en"), (2, "", None), (3, " \t.,", "de")] + rows[:5]
        assert got(spark, rows, min_count=6) == brute(rows, 6, 50, 2000)
        assert got(spark, rows, min_count=3, share=70, limit=4, shards=2) == brute(rows, 3, 70, 4)


def test_ties_and_limits(spark):
    rows = [(i, f"p{j} q{j}.", "en") for j in range(40) for i in range(10)]
    assert got(spark, rows, limit=7) == brute(rows, 10, 50, 7)
    assert got(spark, rows[:0]) == [] and got(spark, [(1, None, None)]) == []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_WORDS", 2)
    rnd = random.Random(9)
    rows = [(i, " ".join(str(rnd.randrange(12)) for _ in range(50)), "en") for i in range(40)]
    assert got(spark, rows) == brute(rows, 10, 50, 2000)
