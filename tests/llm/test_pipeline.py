"""The corpus pipeline, stage by stage, on the smallest table."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from sitebrief.llm import mixing, pieces, secret_scan
from sitebrief.session import read_table
from tests.llm.test_llm import brute_components, brute_quality


def test_stages(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    first, good, single, clean, mixed, encoded = ({} for _ in range(6))
    first, good, single, clean = ({r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:4])
    assert all(t.columns == docs.columns for t in tables[:5])
    assert set(good) < set(first) and all(not brute_quality(t)[5] for t in good.values())
    ids = sorted(good)
    groups = brute_components([good[i] for i in ids])
    assert set(single) == {ids[root] for _, root in groups}
    assert set(clean) == set(single)
    for i, text in clean.items():
        assert not secret_scan.base_spans(text) and (text == single[i] or "[secret]" in text)
    mixed = Counter(r["doc_id"] for r in tables[4].collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_table(tables[3]).collect() if r["copies"]}
    assert mixed == want
    encoded = tables[5].collect()
    assert Counter(r["doc_id"] for r in encoded) == mixed
    decoder = pieces.Decoder(pieces.Vocabulary())
    assert all(decoder.decode(r["ids"]) == clean[r["doc_id"]] for r in encoded)


def test_registered(spark, sf_dir):
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")
                                          and n[2:3].isdigit()) == list(range(1, 14))
    assert names["pipeline"](spark, sf_dir).columns == ["doc_id", "n_tokens", "ids"]
