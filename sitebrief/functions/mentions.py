"""Named mentions: the model hook, and the rules applied to its spans."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions.extract import Contexts
from sitebrief.functions.urls import WS, strip

Spans = list[tuple[int, int, str]]


def entity_type(label: Column, page_level: bool = False) -> Column:
    """Entity type of a model label, null for labels that are not kept."""
    table = P.PAGE_LABELS if page_level else P.LABELS
    out = None
    for t in dict.fromkeys(table.values()):
        names = [k for k, v in table.items() if v == t]
        out = F.when(label.isin(*names), t) if out is None else out.when(label.isin(*names), t)
    return out


def confidence(value: Column) -> Column:
    words = F.size(F.filter(F.split(value, f"{WS}+"), lambda w: w != ""))
    first = F.substring(value, 1, 1)
    upper = value.rlike(r"\p{Lu}") & ~value.rlike(r"\p{Ll}")
    c = (
        F.lit(0.7)
        - F.when(F.length(strip(value)) < 2, 0.3).otherwise(0.0)
        + F.when(first.rlike(r"^\p{Lu}"), 0.1).otherwise(0.0)
        + F.when(words > 1, F.lit(0.05) * F.least(words - 1, F.lit(3))).otherwise(0.0)
        - F.when(upper & (F.length(value) > 3), 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def role(context: Column) -> Column:
    """First role whose pattern occurs; inside longer phrases too ("lead the" gives Lead)."""
    out = None
    for p, name in P.ROLES:
        hit = context.rlike("(?iU)" + p.replace(r"\s", WS))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def relationship(context: Column) -> Column:
    low, out = F.lower(context), None
    for name, words in P.RELATIONSHIPS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


_RULES = [
    (re.compile(r"\$\d[\d,.]*(?:\s(?:million|billion))?"), "MONEY"),
    (re.compile(r"\d+(?:\.\d+)?%"), "PERCENT"),
    (re.compile(r"\b(?:19|20)\d\d\b"), "DATE"),
    (re.compile(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\s(?:Inc|LLC|Ltd|Corp|Company)\b\.?"), "ORG"),
    (re.compile(r"\b[A-Z][a-z]+(?:\s[A-Z]\.)?(?:\s[A-Z][a-z]+){1,2}\b"), "PERSON"),
]


def rule_model(texts: list[str]) -> list[Spans]:
    """A small stand-in for a statistical model: amounts, shares, years, capitalized runs."""
    out = []
    for text in texts:
        spans: Spans = []  # in order, not overlapping
        for pattern, label in _RULES:
            for m in pattern.finditer(text):
                i = bisect.bisect_left(spans, (m.start(),))
                if (i == 0 or spans[i - 1][1] <= m.start()) and (i == len(spans) or spans[i][0] >= m.end()):
                    spans.insert(i, (m.start(), m.end(), label))
        out.append(spans)
    return out


_LOADED: dict[str, Callable[[list[str]], list[Spans]]] = {}


def loaded(name: str, load: Callable[[], Callable[[list[str]], list[Spans]]]) -> Callable[[list[str]], list[Spans]]:
    """A model that each worker loads once, at its first text, and keeps for all later tasks and batches."""
    def call(texts: list[str]) -> list[Spans]:
        if name not in _LOADED:
            _LOADED[name] = load()
        return _LOADED[name](texts)
    return call


def _calls(texts: list[str], most: int) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` characters: what a model is given at a time."""
    part, size = [], 0
    for x in texts:
        if part and size + len(x) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def mention_spans(df: DataFrame, model: Callable[[list[str]], list[Spans]] = rule_model, text: str = "text",
                  most_chars: int = 1 << 20) -> DataFrame:
    """Run a model over the texts in Arrow batches; one row per span, other columns kept. Batches and streams alike.

    A span carries its value and its context, not its text, so that a text with many spans stays small. The model gets
    about ``most_chars`` characters at a time (a longer text alone); see ``loaded`` for one that is costly to build.
    """
    keep = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + (
        "s int, e int, label string, value string, context string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            at = 0
            for texts in _calls([x or "" for x in batch[text]], most_chars):
                rows = []
                for i, (own, found) in enumerate(zip(texts, model(texts)), at):
                    around = Contexts(own)
                    rows += [(i, s, e, label, own[s:e], around(s, e)) for s, e, label in found]
                at += len(texts)
                if not rows:  # columns without a value have no type
                    continue
                hit = batch.loc[[r[0] for r in rows], names].reset_index(drop=True)
                for k, name in enumerate(("s", "e", "label", "value", "context"), 1):
                    hit[name] = [r[k] for r in rows]
                yield hit

    return df.select(*names, text).mapInPandas(run, schema)


def score_spans(spans: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Spans to entities: type, confidence, role or relationship."""
    df = (
        spans.withColumn("type", entity_type(F.col("label")))
        .filter(F.col("type").isNotNull())
        .withColumn("confidence", confidence(F.col("value")))
        .filter(F.col("confidence") >= min_confidence)
    )
    r = F.when(F.col("label") == "PERSON", role(F.col("context")))
    o = F.when(F.col("label").isin("ORG", "NORP"), relationship(F.col("context")))
    extra = F.map_from_entries(F.array_compact(F.array(
        F.when(r.isNotNull(), F.struct(F.lit("role"), r)), F.when(o.isNotNull(), F.struct(F.lit("relationship"), o)))))
    return df.withColumn("extra", extra.cast("map<string,string>"))


def mention_extract(df: DataFrame, model=rule_model, text: str = "text", min_confidence: float = 0.5) -> DataFrame:
    return score_spans(mention_spans(df, model, text), min_confidence)


def answers(df: DataFrame, call: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """Hook for a prompt-to-answer call, run over Arrow batches. No service is shipped."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", answer string"

    def run(batches):
        for batch in batches:
            yield batch.assign(answer=call(list(batch[prompt])))

    return df.mapInPandas(run, schema)


def answer_sources(answer: Column, limit: int | None = None) -> Column:
    """The URLs after the first ``SOURCES:``, the first ``limit`` if given; other spellings of the word give none."""
    tail = F.when(F.instr(answer, "SOURCES:") > 0, F.substring(
        answer, F.instr(answer, "SOURCES:") + 8, F.length(answer)))
    found = F.regexp_extract_all(F.coalesce(tail, F.lit("")), F.lit(f"https?://[^{WS[1:-1]}\\]>]+"), F.lit(0))
    return found if limit is None else F.slice(found, 1, limit)


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template; text that is filled in is not filled again."""
    parts = [F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)
