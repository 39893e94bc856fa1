"""Checkpoint points: a counter that resets, worked out in parallel.

From one checkpoint the next lies at most ``pages`` events ahead, so a block of events is a map from the place where it is
entered (one of its first ``pages`` events, or not at all) to the place where the next block is. Maps are composed up a
tree, ``FAN`` neighbours at a time, and the entries are handed down again; no task ever holds more than one block of
events, or ``FAN`` maps. Jobs of one block, the usual case, need no map at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.operators.chunks import minute, running
from sitebrief.session import cut_lineage

FAN = 64


def _next_points(t: np.ndarray, n: int, pages: int, seconds: float) -> list[int]:
    """For each of the first n events the place of the next checkpoint after one there; len(t) if there is none."""
    nxt = np.arange(n) + pages
    for step in range(pages - 1, 0, -1):
        late = t[step:step + n] - t[:max(min(n, len(t) - step), 0)] >= seconds
        nxt[:len(late)][late] = np.flatnonzero(late) + step
    return np.minimum(nxt, len(t)).tolist()


def _first_point(t: np.ndarray, pages: int, seconds: float) -> int:
    """The first checkpoint of a job: the clock starts with its first event, which counts as one."""
    late = np.flatnonzero(t[:pages] - t[0] >= seconds)
    return min(int(late[0]) if len(late) else pages - 1, pages - 1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(job, block, columns) of rows that come sorted by job and block; a group may lie in several batches."""
    rest = None
    for batch in batches:
        table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = table if rest is None else [np.concatenate(x) for x in zip(rest, table)]
        job, blk = rest[0], rest[1]
        ends = np.flatnonzero((np.diff(job) != 0) | (np.diff(blk) != 0)) + 1
        a = 0
        for b in ends.tolist():
            yield int(job[a]), int(blk[a]), [c[a:b] for c in rest[2:]]
            a = b
        rest = [c[a:] for c in rest]
    if rest is not None and len(rest[0]):
        yield int(rest[0][0]), int(rest[1][0]), rest[2:]


def _compose(maps: Column, pages: int) -> Column:
    """One map for a row of neighbours: where each entry of the first comes out of the last."""
    start = F.sequence(F.lit(0), F.lit(pages - 1))
    return F.aggregate(maps, start, lambda acc, x: F.transform(acc, lambda e: F.when(e >= 0, F.get(x["exits"], e)).otherwise(-1)))


def _entries(maps: DataFrame, first: DataFrame, pages: int) -> DataFrame:
    """(job_id, blk, entry) from the blocks' maps (job_id, blk, exits) and the jobs' first entries (job_id, entry)."""
    levels = [maps]
    while not levels[-1].filter("blk > 0").isEmpty():
        up = levels[-1].groupBy("job_id", F.floor(F.col("blk") / FAN).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("blk", "exits"))).alias("maps"))
        levels[-1] = cut_lineage(up)
        levels.append(cut_lineage(levels[-1].select("job_id", F.col("up").alias("blk"), _compose(F.col("maps"), pages).alias("exits"))))
    entries = first.select("job_id", F.lit(0).cast("long").alias("blk"), "entry")
    for level in reversed(levels[:-1]):
        j = level.join(entries.withColumnRenamed("blk", "up"), ["job_id", "up"])
        init = F.struct(F.col("entry").alias("e"), F.expr("cast(array() as array<struct<blk:bigint,entry:int>>)").alias("out"))
        walk = F.aggregate("maps", init, lambda acc, x: F.struct(
            F.when(acc["e"] >= 0, F.get(x["exits"], acc["e"])).otherwise(-1).alias("e"),
            F.array_append(acc["out"], F.struct(x["blk"].alias("blk"), acc["e"].alias("entry"))).alias("out")))
        entries = j.select("job_id", F.explode(walk["out"]).alias("x")).select("job_id", "x.blk", "x.entry")
    return entries


def checkpoint_points(log: DataFrame, pages: int = 10, seconds: float = 120.0, size: int = 4096) -> DataFrame:
    """job_id, event_id, i of the events at which a checkpoint falls: ``pages`` events or ``seconds`` since the last one."""
    df = running(log.select("job_id", "event_id", "ts"), ["job_id"], ["ts", "event_id"], minute("ts"), rank="rn")
    df = df.select("job_id", "event_id", (F.col("rn") - 1).alias("i"), (F.unix_micros("ts") / 1e6).alias("t"))
    df = cut_lineage(df.withColumn("blk", F.floor(F.col("i") / size)))  # used several times below
    # The next block's head is copied, so that a step over the border can be taken.
    head = df.filter((F.col("i") % size < pages) & (F.col("blk") > 0)).withColumn("blk", F.col("blk") - 1)
    both = df.withColumn("own", F.lit(True)).unionByName(head.withColumn("own", F.lit(False)))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for job, blk, (_, t, own) in _groups(batches):
            n = int(own.sum())
            nxt = _next_points(t, n, pages, seconds)
            # Where each event's chain leaves the block, from the last event to the first.
            leave = [0] * n
            for i in range(n - 1, -1, -1):
                j = nxt[i]
                leave[i] = leave[j] if j < n else (j - n if j < len(t) else -1)
            exits = [leave[e] if e < n else -1 for e in range(pages)]
            first = _first_point(t, pages, seconds) if blk == 0 else len(t)
            out.append((job, blk, exits, first if first < n else -1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32()))],
            names=["job_id", "blk", "exits", "first"])

    order = ["job_id", "blk", "i"]
    long_jobs = df.filter((F.col("blk") == 1) & (F.col("i") == size)).select("job_id")
    blocks = both.join(long_jobs, "job_id", "left_semi").repartition("job_id", "blk").sortWithinPartitions(*order)
    blocks = cut_lineage(blocks.select("job_id", "blk", "event_id", "t", "own").mapInArrow(
        maps, "job_id long, blk long, exits array<int>, first int"))
    entries = _entries(blocks.select("job_id", "blk", "exits"), blocks.filter("blk = 0").select("job_id", F.col("first").alias("entry")), pages)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for job, _, (event, i, t, own, entry) in _groups(batches):
            n = int(own.sum())
            at = _first_point(t, pages, seconds) if entry[0] < -1 else int(entry[0])
            hit = []
            if 0 <= at < n:
                nxt = _next_points(t, n, pages, seconds)
                while at < n:
                    hit.append(at)
                    at = nxt[at]
            found.append(np.stack([np.full(len(hit), job), event[hit], i[hit]]))
            if len(found) > 4096:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in np.concatenate(found, axis=1)], names=["job_id", "event_id", "i"])

    marked = both.join(entries, ["job_id", "blk"], "left").withColumn("entry", F.coalesce("entry", F.lit(-2)))
    marked = marked.repartition("job_id", "blk").sortWithinPartitions(*order)
    return marked.select("job_id", "blk", "event_id", "i", "t", "own", "entry").mapInArrow(mark, "job_id long, event_id long, i long")
