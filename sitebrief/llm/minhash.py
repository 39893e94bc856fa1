"""Near-duplicates by min-max hashing: linked where the Jaccard similarity of word shingles reaches a threshold.

Each of 64 permutations gives two signature values, its minimum and its maximum over the shingle set; both agree with
probability equal to the similarity, so 128 values cost 64 hash evaluations. 32 bands of four values propose candidates
(a link at 0.75 between long texts is missed with probability 5e-6; in short ones minimum and maximum depend on each
other, and with 3 of 4 shingles shared it is (3/4)^32 = 1e-4); links are confirmed on full sets.

Groups of any size are worked without their pairs:

1. Equal sets form a class; only its smallest id goes on.
2. In each bucket the members are compared with one leader, the member that meets most others over all bands. An edited
   copy mostly links to the text it was made from, which meets most.
3. Members of a bucket that are not connected with its leader yet are compared with all members, block by block, sets
   in hand; a block reports links between components that were apart, not pairs.
4. Components are labels of least ids, spread over the links until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.llm.common import written
from sitebrief.llm.hashing import BASE, TABLE, mix, powers

WORDS, PERMUTATIONS, BANDS, THRESHOLD = 5, 64, 32, 75
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_STEP = powers(WORDS + 1, np.uint64(0x9E3779B97F4A7C15))
CHUNK = 1 << 20  # bytes of text that are hashed at a time


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are in lower case already."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    empty = np.empty(0, np.uint64)
    if not len(starts):
        return [empty] * len(texts)
    lengths = np.diff(np.append(starts, len(data)))
    offset = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = TABLE[data[starts[0]:]]
    value[blank[starts[0]:]] = 0
    word = mix(np.add.reduceat(value * powers(int(offset.max()) + 1)[offset], starts - starts[0]))
    first = np.searchsorted(starts, ends - [len(t) + 1 for t in texts])
    last = np.append(first[1:], len(starts))
    n = len(word) - WORDS + 1
    shingle = empty
    if n > 0:
        shingle = sum((word[i:i + n] * _STEP[i + 1] for i in range(1, WORDS)), word[:n] * _STEP[1] + BASE)
        shingle = mix(shingle)
    out = []
    for a, b in zip(first, last):
        if b - a >= WORDS:
            out.append(np.unique(shingle[a:b - WORDS + 1]))
        elif b > a:  # the whole sequence is one shingle; its length tells it from others
            out.append(mix(np.array([int(sum(int(w) * int(_STEP[i + 1]) for i, w in enumerate(word[a:b])) + int(b - a)) % 2**64], np.uint64)))
        else:
            out.append(empty)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side; the sets are not empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for j in range(PERMUTATIONS):
        y = (flat ^ _FLIP[j]) * _ODD[j]
        out[:, 2 * j] = np.minimum.reduceat(y, at)
        out[:, 2 * j + 1] = np.maximum.reduceat(y, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.shape[1] // BANDS
    parts = signature.reshape(len(signature), BANDS, rows)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * BASE
    for i in range(rows):
        keys = mix(keys + parts[:, :, i])
    return keys


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[bytes]]]:
    """Parts of a batch of about CHUNK bytes, so that the arrays of a part stay small."""
    part, held, size = [], [], 0
    for i, text in zip(ids, texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # lowers A-Z only
        part.append(i)
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield part, held
            part, held, size = [], [], 0
    if part:
        yield part, held


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, and the band keys (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                key = np.zeros((2, len(sets)), np.uint64)
                bands = np.empty((0, BANDS), np.uint64)
                if full:
                    flat, at = np.concatenate(full), np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
                    key[0, sizes > 0] = np.add.reduceat(mix(flat), at)
                    key[1, sizes > 0] = np.add.reduceat(mix(flat ^ BASE), at)
                    bands = band_keys(signatures(full))
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes), *(pa.array(k.view(np.int64)) for k in key),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "key1", "key2", "bands"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>")


def full_sets(documents: DataFrame) -> DataFrame:
    """doc_id and its whole shingle set as bytes of sorted 64-bit values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["id", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if min(len(a), len(b)) * 100 < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb")), "b")
    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of the links. Rounds grow with the log of a path's length."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        better = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # Take the label of the label: paths shrink by half in a round.
        over = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        after = written(better.join(over, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("over", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("old != component").limit(1).count() == 0:
            return labels


def _rest_links(buckets: DataFrame, leaders: DataFrame, found: DataFrame, sets: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links of the members that are not connected with their bucket's leader.

    A bucket is dealt into blocks of about ``block`` members by a hash; each pair of a block of such members and a
    block of all members is one task's group.
    """
    own = buckets.join(found, buckets["id"] == found["node"], "left").select(
        "bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    lead = leaders.join(found, leaders["leader"] == found["node"], "left").select(
        "bucket", "leader", F.coalesce("component", "leader").alias("main"))
    rows = written(own.join(lead, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
                   .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    apart = rows.filter("component != main")
    # With two members both have been compared already.
    open_buckets = written(apart.filter("n > 2").groupBy("bucket").agg(F.collect_set("block").alias("left_blocks")), "open")
    members = rows.join(open_buckets, "bucket").select("bucket", "id", "component", "main", "blocks", "block", "left_blocks")
    right = members.select("bucket", "id", "component", F.lit(1).alias("side"), F.explode("left_blocks").alias("lb"), F.col("block").alias("rb"))
    left = members.filter("component != main").select(
        "bucket", "id", "component", F.lit(0).alias("side"), F.col("block").alias("lb"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("rb"))

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side"))
        ids, comp = table.column("id").to_pylist(), table.column("component").to_pylist()
        arrays = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        right = np.flatnonzero(side == 1)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                joined[c] = joined.get(joined[c], joined[c])
                c = joined[c]
            return c

        out = []
        if len(right):
            flat = np.concatenate([arrays[i] for i in right])
            sizes = np.array([len(arrays[i]) for i in right])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for i in np.flatnonzero(side == 0):
                a = arrays[i]
                where = np.minimum(np.searchsorted(a, flat), len(a) - 1)
                both = np.add.reduceat((a[where] == flat).astype(np.int64), at)
                for k in np.flatnonzero(100 * both >= threshold * (len(a) + sizes - both)):
                    x, y = root(comp[i]), root(comp[right[k]])
                    if x != y:  # links inside a component tell nothing new
                        joined[max(x, y)] = min(x, y)
                        out.append((ids[i], ids[right[k]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    both = right.unionByName(left).join(sets, "id").select("bucket", "lb", "rb", "id", "component", "side", "shingles")
    return both.groupBy("bucket", "lb", "rb").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, block: int = 256) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id and kept.

    Texts without words are linked with nothing. Rows with equal ids are one document. Rows with a null id take no part:
    their component is null and they are kept. Other columns are ignored; an empty table gives no rows.
    """
    base = written(sketch(documents), "sketches")
    known = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    keys = ["key1", "key2", "n_shingles"]
    classes = written(known.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    members = classes.select("id", F.explode("bands").alias("bucket"))
    # Sums are written before they are joined: a join of two plain tables is split where a bucket is hot.
    sizes = written(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    buckets = written(members.join(sizes, "bucket"), "buckets")
    # The leader meets most others.
    central = buckets.groupBy("id").agg(F.sum("n").alias("meets"))
    leaders = written(buckets.join(central, "id").groupBy("bucket").agg(
        F.max_by("id", F.struct("meets", -F.col("id"))).alias("leader")), "leaders")
    pairs = buckets.join(leaders, "bucket").filter("id != leader").select(
        F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    ids = written(buckets.select("id").distinct(), "ids")
    sets = written(full_sets(documents.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")), "sets")
    links = written(_verified(pairs, sets, threshold), "star")
    found = components(links)
    rest = written(_rest_links(buckets, leaders, found, sets, threshold, block), "rest")
    found = components(links.unionByName(rest))
    # Rows with equal ids but other texts tie their classes together.
    ties = known.select(*keys, "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    if ties.limit(1).count():
        same = known.join(ties, "doc_id").join(classes.select(*keys, "id"), keys).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        found = components(links.unionByName(rest).unionByName(same.filter("a != b")))
    owner = classes.select(*keys, "id").join(found, F.col("id") == F.col("node"), "left").select(
        *keys, F.coalesce("component", "id").alias("_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return (base.select("doc_id", *keys).join(owner, keys, "left").withColumn("component_id", own)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the least id; columns as they were. Rows without an id stay."""
    gone = near_duplicates(documents, **options).filter("NOT kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
