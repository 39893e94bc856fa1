"""The trie of conversation prefixes, built as a burst trie.

Every conversation is a sequence of turn ids (a digest of role and text). Equal sequences are one class, so copies never
meet. A container holds the suffixes of all classes below one trie head. A container with more than ``limit`` turns
bursts: the turns that all its suffixes share become a chain of nodes at once, and the next turn id deals the rest to
new containers; so rounds follow the branchings of hot prefixes, not their length. The remaining containers are sorted
and swept into nodes, one container in memory at a time. Totals of subtrees are then handed up from containers to the
heads that burst, round by round.

Bounds: a task holds one container, ``limit`` turns and the suffix that exceeds it; one conversation's turn ids (36
bytes a turn) are one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitebrief.llm.common import schema_of, written
from sitebrief.operators.chunks import running

CHUNK = 65_536  # ids of a node's members that are joined into one string
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, up string"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, size: turns in order; equal turn numbers go by id. Rows without a conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    df = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.octet_length(text).cast("long").alias("size"))
    chunk = F.coalesce(F.floor(F.col("turn") / 4096), F.lit(-(1 << 60)))
    return running(df, ["conv_id"], ["turn", "id"], chunk, rank="pos").select("conv_id", "pos", "id", "size")


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: each conversation opens with the first turns of its family's first one (conv_id - conv_id % 5)."""
    turns = written(turn_ids(conversations), "turns")
    h = shared_turns(F.col("conv_id"))
    own = turns.filter(F.col("pos") > h).select("conv_id", (F.col("pos") + 8).alias("pos"), "id", "size")
    convs = turns.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    # At most 8 turns of a family's first conversation go to its few members.
    heads = turns.filter("pos <= 8").select(F.col("conv_id").alias("base"), "pos", "id", "size")
    heads = convs.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", "pos", "id", "size")
    none = convs.select("conv_id", F.lit(None).cast("struct<pos:bigint,id:string,size:bigint>").alias("t"))
    rows = own.unionByName(heads).select("conv_id", F.struct("pos", "id", "size").alias("t")).unionByName(none)
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def member_digests(members: DataFrame) -> DataFrame:
    """ended, ends_sha256: the digest of each class's conversation ids (members: key, conv_id, ended).

    Ids are joined by chunks of their range; a class with very many members is a stream of few long strings.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK)
    parts = members.groupBy("key", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("c"))
    parts = parts.select("key", "chunk", F.get("c", F.lit(0)).alias("least"),
                         F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ended, digest = None, None, None
        for batch in batches:
            done: list[tuple] = []
            for key, least, part in zip(*[c.to_pylist() for c in batch.columns]):
                if key == at:
                    digest.update(b"," + part.encode())
                    continue
                if at is not None:
                    done.append((ended, digest.hexdigest()))
                at, ended, digest = key, least, hashlib.sha256(part.encode())
            yield _digest_rows(done)
        if at is not None:
            yield _digest_rows([(ended, digest.hexdigest())])

    ordered = parts.repartition("key").sortWithinPartitions("key", "chunk").select("key", "least", "part")
    return ordered.mapInArrow(run, "ended long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.string())],
                                      names=["ended", "ends_sha256"])


def sweep(rows: list[tuple]) -> list[tuple]:
    """The nodes of one container: rows (depth, parent_conv, top_size, up, conv, n, ids, sizes) sorted by ids.

    Consecutive suffixes share the stack down to where they part; what is below is closed.
    """
    depth, parent_conv, top_size, up = rows[0][:4]
    # Open nodes, top first: [conv, n, children, leaves, saved, ended, size, nodes closed right below]
    stack: list[list] = []
    out: list[tuple] = []
    path: list[str] = []

    def close() -> None:
        conv, n, children, leaves, saved, ended, size, below = stack.pop()
        saved += (n - 1) * size
        leaves = leaves or 1
        d = depth + len(stack)
        out.extend((c, d + 1, conv, *rest, None) for c, *rest in below)
        node = (conv, n, children, leaves, saved, ended)
        if not stack:
            out.append((conv, d, parent_conv, *node[1:], up))
            return
        above = stack[-1]
        above[0], above[1] = min(above[0], conv), above[1] + n
        above[2], above[3], above[4] = above[2] + 1, above[3] + leaves, above[4] + saved
        above[7].append(node)

    for _, _, _, _, conv, n, ids, sizes in rows:
        if not stack:
            stack.append([conv, 0, 0, 0, 0, None, top_size, []])
        common = 0
        while common < len(path) and common < len(ids) and path[common] == ids[common]:
            common += 1
        while len(stack) > common + 1:
            close()
        for size in sizes[common:]:
            stack.append([conv, 0, 0, 0, 0, None, size, []])
        end = stack[-1]
        end[0], end[1], end[5] = min(end[0], conv), end[1] + n, conv
        path = ids
    while stack:
        close()
    return out


def swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers."""
    types = to_arrow_schema(schema_of(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            nodes = sweep(rows)
            for i in range(0, len(nodes), 10_000):
                columns = list(zip(*nodes[i:i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        for batch in batches:
            for at, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if at != head and rows:
                    yield from out()
                    rows = []
                head = at
                rows.append(tuple(row))
        if rows:
            yield from out()

    ordered = containers.select("head", "depth", "parent_conv", "top_size", "up", "conv", "n", "ids", "sizes")
    return ordered.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(run, NODE)


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def burst(classes: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(containers of at most ``limit`` turns or one suffix, heads that burst by round)."""
    opened = classes.select(
        F.lit("").alias("head"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv"),
        F.lit(0).cast("long").alias("top_size"), F.lit(None).cast("string").alias("up"), "conv", "n", "ids", "sizes")
    closed, heads = None, []
    while True:
        opened = written(opened, "containers")
        load = opened.groupBy("head").agg(
            F.sum(F.size("ids") + 1).alias("load"), F.count("*").alias("suffixes"), F.min("conv").alias("head_conv"), F.sum("n").alias("head_n"),
            F.min("ids").alias("_low"), F.max("ids").alias("_high"))
        load = load.filter((F.col("load") > limit) & (F.col("suffixes") > 1)).select(
            "head", "head_conv", "head_n", _shared(F.col("_low"), F.col("_high")).alias("skip"))
        load = written(load, "burst-heads")
        if load.isEmpty():
            return (opened if closed is None else closed.unionByName(opened)), heads
        both = opened.join(load, "head", "left")
        rest = both.filter("head_n IS NULL").select(opened.columns)
        closed = rest if closed is None else closed.unionByName(rest)
        inside = both.filter("head_n IS NOT NULL")
        ended = F.max(F.when(F.size("ids") == F.col("skip"), F.col("conv"))).alias("ended")
        chain = F.first(F.concat(F.array("top_size"), F.slice("sizes", F.lit(1), F.col("skip")))).alias("chain")
        heads.append(written(inside.groupBy("head", "depth", "parent_conv", "up", "head_conv", "head_n", "skip").agg(chain, ended), "heads"))
        below = inside.filter(F.size("ids") > F.col("skip"))
        at = F.col("skip") + 1
        rest_of = lambda c: F.slice(c, at + 1, F.greatest(F.size(c) - at, F.lit(0)))
        opened = below.select(
            F.md5(F.concat("head", *[F.lit("/")], F.array_join(F.slice("ids", F.lit(1), at), "/"))).alias("head"),
            (F.col("depth") + at).alias("depth"), F.col("head_conv").alias("parent_conv"), F.get("sizes", F.col("skip")).alias("top_size"),
            F.col("head").alias("up"), "conv", "n", rest_of("ids").alias("ids"), rest_of("sizes").alias("sizes"))


def _handed_up(nodes: DataFrame, heads: list[DataFrame]) -> DataFrame:
    """The nodes of the heads that burst: one per chain element, with the totals of what is below."""
    tops = nodes.filter("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
    out, later = None, None
    for head in reversed(heads):
        below = tops if later is None else tops.unionByName(later)
        below = below.groupBy(F.col("up").alias("head")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        j = head.join(below, "head", "left").fillna({"n_children": 0, "n_leaves": 1, "below": 0})
        step = written(j, "handed-up")
        total = lambda i: F.col("below") + (F.col("head_n") - 1) * F.aggregate(
            F.slice("chain", i + 1, F.size("chain") - i), F.lit(0).cast("long"), lambda a, x: a + x)
        each = step.select("*", F.explode(F.sequence(F.lit(0), F.col("skip"))).alias("i"))
        last = F.col("i") == F.col("skip")
        each = each.select(
            F.col("head_conv").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"),
            F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("head_conv")).alias("parent_conv_id"),
            F.col("head_n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves", total(F.col("i")).cast("long").alias("saved_tokens"), F.when(last, F.col("ended")).alias("ended"))
        out = each if out is None else out.unionByName(each)
        later = step.filter("up IS NOT NULL").select("up", "n_leaves", total(F.lit(0)).cast("long").alias("saved_tokens"))
    return out


def prefix_trie(conversations: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn comes first, equal turns go by the digest of role and text, repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation. A conversation without turns ends at the
    root. No conversations, no nodes. Other columns are ignored.
    """
    # A sequence is never stored twice: its key stands for it.
    seqs = written(rebuilt(conversations).withColumn("key", F.md5(F.array_join("ids", "/"))), "sequences")
    classes = seqs.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    containers, heads = burst(classes, limit)
    nodes = written(swept(containers), "nodes")
    whole = nodes.drop("up")
    if heads:
        whole = whole.unionByName(_handed_up(nodes, heads))
    ends = member_digests(seqs.select("key", "conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(ends, "ended", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"))
