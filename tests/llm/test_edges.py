"""Operators and pipeline stages on nulls, empty, repeated and very long rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitebrief.llm import licenses, minhash, mixing, pieces, quality, secret_scan, suffixes, toxicity
from tests.llm.test_llm import DOCS, PROSE, clashing, odd_texts

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def table(spark):
    """Odd texts, each twice, some rows without an id, source or anything."""
    texts = [*odd_texts(), PROSE + ". " + PROSE.title() + ".\r\n" + PROSE.upper() + ".", "password = kT9vQ2mZ4pLx7Wbq9"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows = [*rows, *rows, (None, None, None, None, None), (None, PROSE, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, 0, 1)], LABELS)


TABLES = {
    "op1": lambda spark, d: suffixes.repeats_table(d), "op2": lambda spark, d: secret_scan.scan_secrets(d),
    "op3": lambda spark, d: toxicity.toxicity_table(d, labels(spark)), "op4": lambda spark, d: mixing.mix_table(d),
    "op5": lambda spark, d: quality.quality_table(d), "op6": lambda spark, d: pieces.encoding_table(d),
    "op7": lambda spark, d: minhash.near_duplicates(d), "op10": lambda spark, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_tables(spark, table, name):
    got = [tuple(r) for r in TABLES[name](spark, clashing(table)).collect()]
    assert len(got) == table.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:])
    # Equal rows have equal results; the two rows without an id differ in their texts.
    assert all(len(v) == 2 and (k is None or v[0] == v[1]) for k, v in by_id.items())
    assert TABLES[name](spark, table.limit(0)).collect() == []


def test_pipeline_stages(spark, table, tmp_path):
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        # More columns of a table do no harm; an empty table stays empty.
        odd = clashing(docs.drop("kept", "score")) if name != "encoding" else docs
        out = stage(spark, odd, "")
        assert stage(spark, docs.limit(0), "").collect() == [], name
        if name != "encoding":
            assert out.columns == corpus_pipeline.COLUMNS
        # Stages before the last are judged on the odd rows themselves; the last on what mixing left.
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "quality":
            assert kept and set(kept) <= {5, 6, 11, None}
        elif name in ("near_dedup", "secrets"):
            assert None in kept and len(kept) <= table.count()
        if name == "secrets":
            assert not out.filter(F.col("text").contains("kT9vQ2mZ4pLx7Wbq9")).count()
            assert out.filter("doc_id IS NULL").count() == 2 and out.count() == table.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
    assert len(encoded) == table.count() and all(len(r["ids"]) == r["n_tokens"] for r in encoded)
