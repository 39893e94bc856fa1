"""The license scan and its check agree on notices with more or fewer words, variants and overlaps."""

import random

import duckdb

from sitebrief.llm import licenses, queries

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_plan_equals_check(spark, tmp_path):
    rnd, texts = random.Random(2), [None, "", "mit", "cc by nc", "Under the MIT License. under the mit license"]
    for _, notice in licenses.NOTICES:
        words = notice.split()
        texts.append(notice)
        for _ in range(4):
            w = list(words)
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(w))
                w[i:i + 1] = rnd.choice([[], [w[i], "really"], ["other"], [w[i], w[i]]])
            texts.append("some prose " * rnd.randrange(3) + " ".join(w) + " " + rnd.choice(["", "more", " ".join(words[:5]), rnd.choice(licenses.NOTICES)[1]]))
    rows = [(i // 2 if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)] + [(1, texts[9], None, None, None)]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries.OP10)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert want == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert len({w.rsplit("'", 2)[1] for w in want}) > 12  # labels of every kind
