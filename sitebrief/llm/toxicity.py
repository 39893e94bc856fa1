"""Toxic passages by maximum-scoring segments over token log-odds.

Training: words and word beginnings of labelled documents get log-odds between the classes with a Dirichlet prior (the
pooled shares and half a count). Those that stand out become tokens with a score of their own; a word counts as the
longest of them that fits it. All other words share one score below 0, so that a clean text drifts down. Scoring: the maximal segments of a text (Ruzzo and Tompa, linear time) are the candidate
passages; extreme-value statistics turn a segment's score and the text's length into the number of such segments that
clean text would give by chance. A document's evidence is the sum over its passages, and a logistic curve fitted on the
training rows turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.llm.common import map_texts, written

TOKEN = re.compile(r"\w+")
BEGINNINGS = (7, 6, 5)  # letters of a word beginning, for words that are longer
MEMORY = 500_000  # words a task remembers; a matter of speed only


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)  # tokens that stand out
    rest: float = -0.01  # score of any other token, below 0
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of that law
    intercept: float = -4.0
    slope: float = 1.0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(scores: list[tuple[int, float]], rest: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: (score, first, last token), in order.

    ``scores`` lists the tokens with a score of their own; those between them score ``rest``. Each segment knows the
    nearest one before it that begins lower, so the search to the left follows links and takes linear time in all.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, link
    total, last = 0.0, -1
    for at, score in scores:
        total += rest * (at - last - 1)
        last = at
        if score > 0:
            low, high, first, j = total, total + score, at, len(found) - 1
            while True:
                while j >= 0 and found[j][0] >= low:
                    j = found[j][4]
                if j < 0 or found[j][1] >= high:
                    found.append((low, high, first, at, j))
                    break
                low, first, link = found[j][0], found[j][2], found[j][4]
                del found[j:]
                j = link
        total += score
    return [(high - low, first, end) for low, high, first, end, _ in found]


def forms(word: str) -> list[str]:
    """The word and its beginnings, longest first."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


class Reader:
    """Finds the token of each word; remembers what it found for the words met before."""

    def __init__(self, known):
        self.known, self.seen = known, {}

    def token(self, word: str) -> str | None:
        found = next((f for f in forms(word) if f in self.known), None)
        if len(self.seen) >= MEMORY:
            self.seen.clear()
        self.seen[word] = found
        return found

    def __call__(self, words: list[str]) -> list[tuple[int, str]]:
        """(place, token) of the words that have one."""
        seen, token = self.seen, self.token
        found = [seen[w] if w in seen else token(w) for w in words]
        return [(i, t) for i, t in enumerate(found) if t is not None]


def evidence(n_words: int, own: list[tuple[int, float]], model: ToxicityModel, least: float = 3.0) -> tuple[float, list[tuple[float, int, int]]]:
    """Sum of -log p over the passages, and the passages with -log p of ``least`` or more (significant at 5 %).

    p is the chance that clean text of this length has a segment of this score; of the others only the best counts.
    """
    found = []
    for score, first, end in segments(own, model.rest):
        expected = model.scale * max(1, n_words) * math.exp(-model.decay * score)
        found.append((-math.log(max(-math.expm1(-expected), 1e-300)), first, end))
    strong = [f for f in found if f[0] >= least]
    return (sum(f[0] for f in strong) or max((f[0] for f in found), default=0.0)), strong


def probability(model: ToxicityModel, total: float) -> float:
    x = model.intercept + model.slope * math.log1p(total)
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


# --- training -----------------------------------------------------------------------------------------------------

def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id-free training texts: for each class the ``per_class`` labelled ids with the least hash, folds 1 to 4.

    The ids are bounded by 2 * per_class, and so is what is broadcast. The sample is a table in the shared folder.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).join(sample, "doc_id")
    return written(rows.dropDuplicates(["toxic", "h"]).select("toxic", "text"), "toxic-sample")  # copies count once


def _counted(sample: DataFrame, make) -> DataFrame:
    """token, clean, toxic over ``make()(text)``; a text counts a word once. Summed in each batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in batches:
            counts = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(read(text or ""))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)],
                names=["token", "clean", "toxic"])

    each = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "token string, clean long, toxic long")
    return each.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def standing_out(sample: DataFrame, prior: float, least_z: float, most_tokens: int) -> list[str]:
    """Words and beginnings whose log-odds differ from 0 by ``least_z`` deviations, the strongest first."""
    counts = _counted(sample, lambda: lambda text: {f for w in tokens(text) for f in forms(w)})
    words = counts.filter(~F.endswith("token", F.lit("-"))).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n = {"clean": words["clean"] or 0, "toxic": words["toxic"] or 0}
    if not n["clean"] or not n["toxic"]:
        return []
    a = (F.col("clean") + F.col("toxic")) * (prior / (n["clean"] + n["toxic"])) + 0.5
    odds = lambda y: F.log((F.col(y) + a) / F.greatest(n[y] + prior - F.col(y) - a, F.lit(1.0)))
    z = F.abs((odds("toxic") - odds("clean")) / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)))
    rows = counts.select("token", z.alias("z")).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "token").limit(most_tokens)
    return [r["token"] for r in rows.collect()]


def token_shares(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int, prior: float) -> dict[str, tuple[float, float]]:
    """(clean, toxic) share of each token under a Dirichlet prior, the same for both classes: the token's pooled share
    of ``prior`` words, and half a word for each token and for the rest, so that no share is 0."""
    mass = prior + 0.5 * (len(counts) + 1)
    alpha = {t: prior * (c + x) / (n_clean + n_toxic) + 0.5 for t, (c, x) in counts.items()}
    return {t: ((c + alpha[t]) / (n_clean + mass), (x + alpha[t]) / (n_toxic + mass)) for t, (c, x) in counts.items()}


def learn_scores(sample: DataFrame, names: list[str], prior: float) -> tuple[dict[str, float], float, list[tuple[float, float]]]:
    """Scores of the tokens, the score of the rest, and (clean share, score) of each for calibration."""
    known = frozenset(names)

    def make():
        reader = Reader(known)
        return lambda text: [""] * len(words := list(set(tokens(text)))) + [t for _, t in reader(words)]  # "" counts words

    rows = {r["token"]: (r["clean"], r["toxic"]) for r in _counted(sample, make).collect()}  # len(names) + 1 at most
    n_clean, n_toxic = rows.pop("", (0, 0))
    if not rows or not n_clean or not n_toxic:
        return {}, -1e-3, []
    shares = token_shares(rows, n_clean, n_toxic, prior)
    scores = {t: math.log(x / c) for t, (c, x) in shares.items()}
    left_clean, left_toxic = (1 - sum(v[k] for v in shares.values()) for k in (0, 1))
    rest = min(-1e-3, math.log(left_toxic / left_clean)) if left_toxic > 0 and left_clean > 0 else -1e-3
    return scores, rest, [*((shares[t][0], s) for t, s in scores.items()), (max(left_clean, 0.0), rest)]


def decay_rate(shares: list[tuple[float, float]]) -> float:
    """The positive root of sum(p * exp(x * s)) = 1 by halving; 1 where there is none."""
    excess = lambda x: sum(p * math.exp(min(50.0, x * s)) for p, s in shares) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    if not shares or excess(low) >= 0 or excess(high) < 0:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge, which keeps separable data finite."""
    design, theta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _statistics(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    """toxic, n tokens, best segment, evidence of each training text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.scores)
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text or "")
                own = [(i, model.scores[t]) for i, t in reader(words)]
                best = max((s[0] for s in segments(own, model.rest)), default=0.0)
                rows.append((label, len(words), best, evidence(len(words), own, model)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else
                                             [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                                             names=["toxic", "n", "best", "total"])

    return sample.select(F.col("toxic").cast("long"), "text").mapInArrow(run, "toxic long, n long, best double, total double")


def train(documents: DataFrame, labels: DataFrame, per_class: int = 10_000, prior: float = 500.0, least_z: float = 3.0,
          most_tokens: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows (``per_class`` documents a class at most) outside fold 0.

    ``prior`` is the weight of the pooled shares in words, in choosing tokens and in scoring them. Of the tokens that stand
    out by ``least_z`` deviations the ``most_tokens`` strongest are learnt: with ``per_class`` the model's size bound.
    Without rows of both classes the model gives every text the same low score.
    """
    sample = training_rows(documents, labels, per_class)
    scores, rest, shares = learn_scores(sample, standing_out(sample, prior, least_z, most_tokens), prior)
    model = ToxicityModel(scores, rest, decay_rate(shares))
    if not scores:
        return model
    # Most likely K for the best segments of clean texts: as many as expected.
    clean = _statistics(sample, model).filter("toxic = 0").agg(
        F.count("*").alias("k"), F.sum(F.greatest("n", F.lit(1)) * F.exp(-F.lit(model.decay) * F.col("best"))).alias("e")).first()
    model.scale = clean["k"] / max(clean["e"] or 0.0, 1e-12)
    rows = _statistics(sample, model).select("toxic", "total").toPandas()  # as many rows as the sample's bound
    y = rows["toxic"].to_numpy(float)
    known = labels.filter(remainder(F.col("doc_id")) != 0).groupBy("toxic").count().collect()
    seen = {r["toxic"]: r["count"] for r in known}
    weight = np.where(y == 1, seen.get(1, 0) / max(1, (y == 1).sum()), seen.get(0, 0) / max(1, (y == 0).sum()))
    model.intercept, model.slope = fit_logistic(np.log1p(rows["total"].to_numpy(float)), y, weight / weight.mean())
    return model


# --- scoring ------------------------------------------------------------------------------------------------------

def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row: score, predicted, and the significant toxic passages as start:end in code points.

    A null or empty text has no evidence and gets the model's lowest score.
    """
    def make():
        reader = Reader(model.scores)

        def score(text: str):
            words = tokens(text)
            total, strong = evidence(len(words), [(i, model.scores[t]) for i, t in reader(words)], model)
            p = probability(model, total)
            passages = ""
            if strong:
                low = text.lower()
                at = [m.span() for m in TOKEN.finditer(low if len(low) == len(text) else text)]
                passages = ",".join(f"{at[a][0]}:{at[min(b, len(at) - 1)][1]}" for _, a, b in strong if a < len(at))
            return p, int(p >= 0.5), len(strong), passages
        return score

    return map_texts(documents, make, "doc_id long, score double, predicted int, n_passages long, passages string")


def toxicity_table(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The contract's table: one row per row of ``documents``. Repeated labels of an id count as toxic if any is."""
    model = train(documents, labels, **options)
    return score_documents(documents, model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted",
        "n_passages", "passages")
