"""Dirichlet shares by hand, and scores on held-out rows of planted texts."""

import math
import random
import zlib

from sitebrief.llm import toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_shares_follow_the_prior():
    counts, n_clean, n_toxic = {"bad": (1, 30), "good": (40, 2)}, 1000, 200
    got = toxicity.token_shares(counts, n_clean, n_toxic, 50.0)
    alpha = 50 * 31 / 1200 + 0.5  # pooled share of 50 words, and half a word
    assert math.isclose(got["bad"][0], (1 + alpha) / (1000 + 51.5)) and math.isclose(got["bad"][1], (30 + alpha) / (200 + 51.5))
    # A heavier prior draws both classes together.
    odds = lambda prior: math.log((s := toxicity.token_shares(counts, n_clean, n_toxic, prior)["bad"])[1] / s[0])
    assert odds(1.0) > odds(100.0) > odds(10_000.0) > 0


def test_held_out_rows(spark):
    rnd, rows, labels = random.Random(4), [], []
    plain = [f"w{i}" for i in range(300)]
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            at = rnd.randrange(40)
            words[at:at + 8] = [rnd.choice(["vile", "scum", "filth", "trash"]) if rnd.random() < 0.8 else rnd.choice(plain) for _ in range(8)]
        rows.append((i, " ".join(words), None, None, 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), (None, "w1 w2", None, None, 1)]
    docs, known = spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_table(docs, known).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and len(got) == len(rows)
    right = sum(got[i]["predicted"] == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] <= min(r["score"] for r in got.values()) + 1e-12
