"""Token counts against the library on whole texts."""

import random

import sentencepiece

from sitebrief.llm import pieces, token_counts
from sitebrief.llm.common import documents

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return [len(library.encode(t or "")) for t in texts]


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in token_counts.token_table(docs).collect()}
    assert len(got) == len(rows)
    for row, n in zip(rows, brute([r["text"] for r in rows])):
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (n, len((row["text"] or "").encode()))
        assert r["over_limit"] == (n > 4096)


def test_odd_texts(spark):
    rnd, chars = random.Random(3), " ab\t\n\r▁é漢😀<s></s>= ​　ﬁ́\x01"
    texts = [None, "", " ", "  ", "a", " a", "a  b ", "▁", "▁a ▁", "<s> </s> <unk>", "\n\n", "x" * 70_000, "ab " * 30_000]
    texts += ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(400)]
    texts += ["a b", "a b"]
    df = spark.createDataFrame([(i // 2, t, None, None, None) for i, t in enumerate(texts)], DDL)  # ids repeat
    got = token_counts.token_table(df).collect()
    want = sorted(zip([i // 2 for i in range(len(texts))], brute(texts)))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_table(df.limit(0)).collect() == []


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1, "x"), (7, None, 2, "y")], "doc_id long, text string, n_tokens long, pretoken string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_table(df).collect()}
    assert got == {None: 2, 7: 0}


def test_long_pretokens_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 50)
    monkeypatch.setattr(token_counts, "CACHE", 2000)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcd=+ ") if rnd.random() < 0.1 else rnd.choice("abcd=") for _ in range(3000)) for _ in range(20)]
    lengths = token_counts.Lengths(None, pieces.MODEL)
    got = []
    for t in texts:
        lengths.shrink()
        got += lengths.count([t])
    assert got == brute(texts)
