"""Model mentions on a stream equal those of a batch, over restarts; models get bounded runs of text."""

import random

from sitebrief.functions import mentions as M
from sitebrief.streaming import live as V


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rnd, schema = random.Random(5), "page_id long, text string"
    words = ["Jane", "Q.", "Public", "Acme", "Inc", "$5", "million", "12%", "1999", "éParis", "the", "of", "\n", "Smith"]
    rows = [(i, None if i % 17 == 0 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(90)]
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        model = M.loaded("test", lambda: M.rule_model)
        got = V.run_to_files(M.mention_extract(stream, model).select("page_id", "s", "e", "label", "value", "context"), str(tmp_path / "run"))
    want = M.mention_extract(spark.createDataFrame(rows, schema)).select("page_id", "s", "e", "label", "value", "context")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_runs_of_text_are_bounded_and_models_load_once():
    parts = list(M._calls(["a" * 5, "b" * 5, "c" * 50, "", "d"], 10))
    assert parts == [["a" * 5, "b" * 5], ["c" * 50], ["", "d"]] and list(M._calls([], 10)) == []
    made = []
    model = M.loaded("once", lambda: made.append(1) or M.rule_model)
    assert model(["In 1999"]) == model(["In 1999"]) == [[(3, 7, "DATE")]] and made == [1]
