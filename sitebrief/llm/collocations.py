"""Phrase collocations by SON partitioning, exact at every step that decides a result.

1. Documents are dealt to ``shards`` shards by a hash. Each shard is mined completely: all its phrases of 2 and 3 words
   are counted, by the 64-bit hash of language and words, and those that reach the support lowered in proportion,
   ``min_count / shards``, stay. A phrase that reaches it in no shard cannot reach ``min_count`` in all, and a hash that
   two phrases share only adds to their counts, so no frequent phrase is lost.
2. The union over shards goes into a bit filter of fixed size (``FILTER_WORDS`` words of 64 bits; one word a phrase).
   It is the only thing broadcast, and its size does not depend on the data.
3. The texts are read again, and all occurrences of phrases that pass the filter are counted, by their words. What the
   filter lets through in error is counted exactly as well and falls to ``min_count``.

Texts are cut in windows of bounded size, words and phrases are worked out on their bytes in numpy; what goes through a
shuffle has been counted per window before. Very long texts are cut between words: a phrase belongs to the window in
which it starts, and each window sees two words beyond its end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitebrief.llm.common import written
from sitebrief.llm.hashing import BASE, TABLE, mix
from sitebrief.operators.chunks import top

WINDOW = 1 << 20  # bytes of text in work at a time
GATHER = 1 << 19  # words whose phrases are counted before they leave the task
FILTER_WORDS = 1 << 21
HASHED = 48  # bytes of a word that are hashed side by side; longer words are hashed one by one
JOIN = np.uint64(0x9E3779B97F4A7C15)

# Bytes: 0 in words, 1 blanks between words, 2 between pieces. All are ASCII, so UTF-8 is never cut inside a character.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_WORD, _SPLIT = rb"[^\x20\x09.,;:!?\n-\r]", re.compile(rb"[\x20\x09.,;:!?\n-\r]")
_NEXT = re.compile(rb"[\x20\x09]*(?:" + _WORD + rb"+[\x20\x09]+)?" + _WORD + rb"*")


def windows(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, bytes, int]]:
    """(key, bytes, size of the part whose phrases count) of the texts of a batch; the first columns are the key."""
    groups = defaultdict(list)
    for i, key in enumerate(zip(*[batch.column(j).to_pylist() for j in range(n_keys)])):
        groups[key].append(i)
    texts = batch.column(n_keys)
    for key, rows in groups.items():
        part, size = [], 0
        for i in rows:
            part.append(texts[i].as_buffer())
            size += part[-1].size
            if size >= WINDOW:
                yield from _cut(key, b"\n".join(part))
                part, size = [], 0
        if part:
            yield from _cut(key, b"\n".join(part))


def _cut(key: tuple, data: bytes) -> Iterator[tuple[tuple, bytes, int]]:
    a = 0
    while a < len(data):
        b = end = len(data)
        if len(data) - a > 2 * WINDOW:
            stop = _SPLIT.search(data, a + WINDOW)
            if stop:
                b = stop.start()
                end = _NEXT.match(data, b).end()
        yield key, data[a:end], b - a
        a = b


class Words:
    """The words of a window: their bytes one blank apart, their pieces, and which of them start phrases."""

    def __init__(self, data: bytes, body: int):
        raw = LOWER[np.frombuffer(data + b"\n", np.uint8)]
        kind = KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.counted = int(np.searchsorted(starts, body))
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.joined = piece[1:] == piece[:-1]  # word i and the next one
        self.sizes = (ends - starts).astype(np.int32)
        keep = inside | (edge == -1)
        self.bytes = np.where(inside, raw, np.uint8(32))[keep]
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)]).astype(np.int32)

    def phrases(self, k: int) -> np.ndarray:
        """First words of the phrases of k words that count."""
        n = len(self.sizes) - k + 1
        ok = np.ones(max(n, 0), bool)
        for j in range(k - 1):
            ok &= self.joined[j:j + len(ok)]
        return np.flatnonzero(ok[:self.counted])

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits per word; equal words have equal hashes."""
        h = np.full(len(self.sizes), seed, np.uint64)
        at, sizes, rows = self.at[:-1], self.sizes, np.arange(len(self.sizes))
        for j in range(HASHED):
            rows = rows[sizes[rows] > j]
            if not len(rows):
                break
            h[rows] = h[rows] * BASE + TABLE[self.bytes[at[rows] + j]]
        for i in np.flatnonzero(sizes > HASHED).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes[at[i]:at[i] + sizes[i]].tobytes(), seed=seed)
        return mix(h)

    def phrase_hashes(self, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(k, first words, hashes) for k = 2, 3."""
        h, out = self.hashes(seed), []
        for k in (2, 3):
            first = self.phrases(k)
            g = h[first]
            for j in range(1, k):
                g = mix(g * JOIN + h[first + j])
            out.append((k, first, g))
        return out

    def texts(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words as strings, one blank between words."""
        start = self.at[first]
        sizes = self.at[first + k] - 1 - start
        ends = np.cumsum(sizes, dtype=np.int64)
        index = np.repeat((start - ends + sizes).astype(np.int32), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[index])])


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


# --- 1: shards

def shard_counts(texts: DataFrame, shards: int) -> DataFrame:
    """shard, h, n: occurrences of each phrase hash in each shard, in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), shard, np.int32)), pa.array(h.view(np.int64)), pa.array(n, pa.int32())], names=["shard", "h", "n"])
            held.clear()

        for batch in batches:
            for (lang, shard), data, body in windows(batch, 2):
                words = Words(data, body)
                held[shard] += [g for _, _, g in words.phrase_hashes(seed_of(lang))]
                size += len(words.sizes)
                if size >= GATHER:
                    yield from out()
                    size = 0
        yield from out()

    # Any deal of occurrences to shards is complete; the hash makes shards of equal size, and runs agree.
    shard = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int")
    return texts.select("lang", shard.alias("shard"), "text").mapInArrow(run, "shard int, h long, n int")


def _bits(h: str = "h"):
    """The bits of a phrase in its filter word."""
    bits = [f"shiftleft(1L, cast(shiftright({h}, {s}) & 63 AS INT))" for s in (24, 32, 40, 48)]
    return F.expr(" | ".join(bits))


def local_filter(counts: DataFrame, support: int) -> np.ndarray:
    """The bit filter over the phrases that reach the support in some shard."""
    # Rows are distinct in what each task has gathered; combining them again before the shuffle finds next to nothing.
    local = counts.repartition("shard", "h").groupBy("shard", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    words = local.select((F.col("h").bitwiseAND(FILTER_WORDS - 1)).alias("word"), _bits().alias("bits"))
    # At most FILTER_WORDS rows, whatever the data.
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passing(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(g), np.uint64)
    for s in (24, 32, 40, 48):
        bits |= np.uint64(1) << ((g >> np.uint64(s)) & np.uint64(63))
    return (table[(g & np.uint64(len(table) - 1)).astype(np.int64)] & bits) == bits


# --- 2: exact counts

def exact_counts(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """lang, k, phrase, n: all words and all phrases that pass the filter, in parts."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bits = defaultdict(list), 0, shared.value

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, k), parts in held.items():
                counts = pc.value_counts(pa.chunked_array(parts, pa.binary()))
                phrase, n = counts.field("values"), counts.field("counts")
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(n)), pa.repeat(pa.scalar(k, pa.int32()), len(n)), phrase.cast(pa.string()), n], names=["lang", "k", "phrase", "n"])
            held.clear()

        for batch in batches:
            for (lang,), data, body in windows(batch, 1):
                words = Words(data, body)
                held[lang, 1].append(words.texts(np.arange(words.counted), 1))
                for k, first, g in words.phrase_hashes(seed_of(lang)):
                    held[lang, k].append(words.texts(first[passing(bits, g)], k))
                size += len(words.sizes)
                if size >= GATHER:
                    yield from out()
                    size = 0
        yield from out()

    return texts.select("lang", "text").mapInArrow(run, "lang string, k int, phrase string, n long")


# --- 3: scores

def first_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str) -> DataFrame:
    """First k rows per key, in steps of fewer and fewer groups, so that one hot key is never ranked in one task."""
    salt = F.xxhash64(*[c for c in df.columns])
    for groups in (1024, 16):
        df = top(df.withColumn("_salt", F.pmod(salt, F.lit(groups))), [*keys, "_salt"], order, k, "_rank").drop("_rank", "_salt")
    return top(df, keys, order, k, rank)


def score_phrases(counts: DataFrame, min_count: int, share: int, limit: int) -> DataFrame:
    """The collocations of ``counts`` (lang, k, phrase, n: words, and phrases of 2 and 3 words with n >= min_count)."""
    long_ = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    # The most frequent longer phrase around each phrase of two words.
    around = long_.filter("k = 3").select("lang", F.explode(F.array(
        F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = long_.join(around, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {share} * a")).drop("longer")
    cut = lambda i: F.struct(F.lit(i).alias("cut"), F.array_join(F.slice(words, 1, i), " ").alias("head"),
                             F.array_join(F.slice(words, F.lit(i + 1), F.col("k")), " ").alias("tail"))
    cuts = left.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(cut(1), F.when(F.col("k") == 3, cut(2))))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.cut", "c.head", "c.tail")
    part = counts.filter("k < 3").select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("up", (big("a") * big("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"))
    cuts = cuts.withColumn("down", big("l") * big("r")).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    best = first_rows(best, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], limit, "rank")
    n = counts.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(documents: DataFrame, min_count: int = 10, share: int = 50, limit: int = 2000, shards: int = 3) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit`` collocations of 2 and 3 words.

    Texts are lower-cased in A-Z, split at .,;:!? and line ends into pieces and at blanks and tabs into words. A phrase
    with ``min_count`` occurrences counts unless a phrase of three words around it has ``share`` percent of them. Its
    score is floor(1,000,000 a a / (l r)) at the cut where it is least, the first such cut. A null lang is ``und``; null
    and empty texts have no words; repeated rows count each time; equal scores go by count, then phrase; no documents,
    no rows; other columns are ignored.
    """
    texts = documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    table = local_filter(shard_counts(texts, shards), -(-min_count // shards))
    counts = exact_counts(texts, table).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(f"k = 1 OR n >= {min_count}"), "collocations")
    return score_phrases(counts, min_count, share, limit)
