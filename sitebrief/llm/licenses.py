"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same k-grams in license texts.
Each match votes for a diagonal, its document position less its template position. Votes are summed per diagonal,
neighbouring diagonals are merged (a word more or less shifts the rest), and a merged span is taken when it covers
enough of its template within a fitting length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The contract's phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices by which licenses are named, and the opening sentences of their texts.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
)
# Kinds of Creative Commons licenses that are told apart by a word.
VARIANTS = tuple(
    (label, text) for label, long, short in (
        ("cc-by-sa", "ShareAlike", "SA"), ("cc-by-nd", "NoDerivatives", "ND"), ("cc-by-nd", "NoDerivs", "ND"),
        ("cc-by-nc-sa", "NonCommercial-ShareAlike", "NC-SA"), ("cc-by-nc-nd", "NonCommercial-NoDerivatives", "NC-ND"),
        ("cc-by-nc-nd", "NonCommercial-NoDerivs", "NC-ND"))
    for text in (f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License",
                 f"Licensed under CC BY-{short} 4.0"))
NOTICES = tuple(dict.fromkeys(TEMPLATES + VARIANTS))
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def license_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, GAP), lambda w: w != "")


def template_grams(templates: Sequence[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, list[str]]]:
    """(template number, label, its words, position, k-gram)"""
    return [(t, label, len(words), p, words[p:p + k])
            for t, (label, text) in enumerate(templates) for words in [template_words(text)]
            for p in range(len(words) - k + 1)]


def _template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    rows = template_grams(templates, k)
    table = spark.createDataFrame(rows, "template int, label string, n int, tpos int, gram array<string>")
    table = table.select("template", "label", "n", "tpos", F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias("h"))
    return F.broadcast(table) if len(rows) <= 100_000 else table  # a long list of templates is shuffled instead


def license_spans(documents: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, k: int = 3,
                  least: float = 0.75, slip: int = 2) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, template, start and end (words, end exclusive), coverage (0 to 1).

    A span joins diagonals at most ``slip`` apart; coverage is the share of the template's words inside matching
    k-grams, where words that the document has more count as words missed. Of spans that overlap the one with the best
    coverage stays. Templates shorter than k words are not found. Rows with equal id and text count once.
    """
    words = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("words"))
    words = words.withColumn("words", F.explode(F.array("words"))).filter(F.size("words") >= k)
    starts = F.sequence(F.lit(0), F.size("words") - k)
    hashes = F.transform(starts, lambda p: F.xxhash64(*[F.get("words", p + i) for i in range(k)]))
    grams = words.select("doc_id", "text_hash", F.posexplode(hashes).alias("pos", "h"))
    votes = grams.join(_template_table(documents.sparkSession, templates, k), "h")
    keys = ["doc_id", "text_hash", "template"]
    diagonals = votes.groupBy(*keys, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("n").alias("n"), F.min("pos").alias("start"),
        (F.max("pos") + k).alias("end"), F.collect_set("tpos").alias("tpos"))
    order = W.partitionBy(*keys).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slip, F.lit(True))
    merged = (diagonals.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order))
              .groupBy(*keys, "span").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("start").alias("start"),
                                          F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + k - 1)))))
    fits = F.col("end") - F.col("start") <= F.col("n") * 1.25 + slip
    more = F.greatest(F.lit(0), F.col("end") - F.col("start") - (F.array_max("tpos") - F.array_min("tpos") + k))
    spans = merged.withColumn("coverage", covered / (F.col("n") + more)).filter((F.col("coverage") >= least) & fits)
    return _best(spans)


def _best(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the best: taken from the best coverage down, unless one that is taken overlaps."""
    keys = ["doc_id", "text_hash"]
    order = W.partitionBy(*keys).orderBy("start", "end", "template")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    row = F.struct((-F.col("coverage")).alias("rank"), "n", "template", "start", "end", "label", "coverage")
    islands = spans.groupBy(*keys, "island").agg(F.sort_array(F.collect_list(row)).alias("all"))
    apart = lambda x: lambda y: (y["end"] <= x["start"]) | (x["end"] <= y["start"])
    taken = F.aggregate("all", F.slice("all", 1, 1),
                        lambda kept, x: F.when(F.forall(kept, apart(x)), F.concat(kept, F.array(x))).otherwise(kept))
    return islands.select(*keys, F.explode(taken).alias("s")).select(
        *keys, *[F.col("s")[c].alias(c) for c in ("label", "template", "start", "end", "coverage")])


def _places(joined: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number, first and last place (in words) of a phrase in words that stand between single blanks on both sides."""
    p = " " + phrase.replace(" ", "  ") + " "
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    at = lambda n: F.floor(blanks(F.substring(joined, F.lit(1), n)) / 2)
    found = F.contains(joined, F.lit(p))
    number = F.floor((F.length(joined) - F.length(F.replace(joined, F.lit(p), F.lit("")))) / len(p))
    first = F.locate(p, joined) - 1
    last = F.length(joined) - (F.locate(p[::-1], F.reverse(joined)) - 1) - len(p)
    return F.when(found, number).otherwise(F.lit(0).cast("bigint")), F.when(found, at(first)), F.when(found, at(last))


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, **options) -> DataFrame:
    """One row per row of ``documents``: base places and labels, all labels, and a score.

    The score is 1 with a base place, else the best coverage of a span, else 0. A null or empty text has no words;
    repeated rows give equal rows; other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("words"))
    docs = docs.withColumn("words", F.explode(F.array("words")))
    docs = docs.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words"),
                       F.explode(F.array(F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))).alias("joined"))
    numbers, firsts, lasts = zip(*(_places(F.col("joined"), p) for p, _ in PHRASES))
    base = F.filter(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(numbers, PHRASES)]), lambda x: x.isNotNull())
    docs = docs.select("doc_id", "text_hash", "n_words", sum(numbers[1:], numbers[0]).alias("n_base"),
                       F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
                       F.sort_array(F.array_distinct(base)).alias("_base"))
    spans = license_spans(documents.select("doc_id", "text"), templates, **options)
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("_more"), F.max("coverage").alias("_coverage"), F.count("*").alias("_n")
    ).withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    both = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_doc_id")) & (docs["text_hash"] == F.col("_text_hash")), "left")
    labels = F.sort_array(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_coverage", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), score.alias("score"),
                       F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_spans"))
