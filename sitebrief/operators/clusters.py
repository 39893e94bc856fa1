"""Greedy clusters of names: each joins the first leader it matches, in a given order, or becomes a leader.

The leaders are the lexicographically first independent set of the match graph, and need not be found one by one:

* The first block of a group's names (``block``, a bound) is clustered in one task.
* All later names are compared with its leaders, and those that match leave with the first leader they match.
* Of the names left, a prefix twice as long as all before is taken. A prefix is decided in rounds: a name is a leader
  once all earlier names that it matches are known not to lead. Rounds follow the longest chain of such names, not the
  number of leaders; and as each prefix has lost what matches the leaders before it, its links stay few.

Names meet in pairs of blocks, blocks of names with leaders (a stated set) or with earlier blocks of one prefix; only
matches leave a task. Similarity at 0.85 of names this short has no selective key (rarest grams and split character
counts both yield more candidates than there are pairs), so a block pair is worked out by arrays: lengths, then character
counts, whose difference is at most that of the names, leave a few pairs for the exact test. Blocks follow the order,
which goes by length, so that blocks of too different lengths never meet when only similarity counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.operators.chunks import running
from sitebrief.session import cut_lineage, scratch_path

THRESHOLD = 0.85
BLOCK = 4096
BUCKETS = 64  # characters are counted by code modulo this
KEY = ["company_id", "type"]


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character of b."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similar(a: str, b: str) -> bool:
    if not a or not b:
        return False
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / total < THRESHOLD:
        return False
    return a == b or 2.0 * lcs_length(a, b) / total >= THRESHOLD


def org_similar(a: str, b: str) -> bool:
    return a in b or b in a or similar(a, b)


class Bags:
    """Names with their character counts, for tests of one name against all."""

    def __init__(self, names: list[str], contain: bool):
        self.names, self.test, self.contain = names, org_similar if contain else similar, contain
        self.sizes = np.array([len(n) for n in names], np.int32)
        at = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS
        row = np.repeat(np.arange(len(names)), self.sizes)
        counts = np.bincount(row * BUCKETS + at, minlength=len(names) * BUCKETS) if len(names) else np.zeros(0)
        # Counts stop at 255; that only makes differences smaller.
        self.counts = np.minimum(counts, 255).reshape(-1, BUCKETS).astype(np.int16)

    def maybe(self, size: int, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of some rows, those that may match a name of this size and these counts; none that does is left out."""
        sizes = self.sizes[rows]
        total = sizes + size
        fit = 2.0 * np.minimum(sizes, size) >= THRESHOLD * total - 1e-9
        if self.contain:
            diff = self.counts[rows] - counts
            inside = (diff >= 0).all(1) | (diff <= 0).all(1)
            return rows[inside | (fit & (np.abs(diff).sum(1) <= (1 - THRESHOLD) * total + 1e-6))]
        rows, total = rows[fit], total[fit]
        return rows[np.abs(self.counts[rows] - counts).sum(1) <= (1 - THRESHOLD) * total + 1e-6]

    def matches(self, other: Bags, i: int, rows: np.ndarray):
        """Rows that match name i of ``other``, in order."""
        name = other.names[i]
        for j in self.maybe(int(other.sizes[i]), other.counts[i], rows).tolist():
            if self.test(name, self.names[j]):
                yield j


def fold(names: list[str], contain: bool) -> list[int]:
    """The leader of each name, by position; names are in order."""
    bags, leaders, lead = Bags(names, contain), np.zeros(len(names), np.int64), []
    n = 0
    for i in range(len(names)):
        hit = next(bags.matches(bags, i, leaders[:n]), None)
        if hit is None:
            leaders[n], hit, n = i, i, n + 1
        lead.append(hit)
    return lead


def _blocks(df: DataFrame, block: int) -> DataFrame:
    """One row per block of a group's names in order: block, names, o1, o2, least and most characters."""
    at = F.array_sort(F.collect_list(F.struct("o1", "o2", "name"))).alias("x")
    b = df.withColumn("block", F.floor((F.col("rn") - 1) / block)).groupBy(*KEY, "block").agg(
        at, F.min(F.length("name")).alias("low"), F.max(F.length("name")).alias("high"))
    return b.select(*KEY, "block", "low", "high", F.col("x.name").alias("names"), F.col("x.o1").alias("o1"), F.col("x.o2").alias("o2"))


def _meet(low: DataFrame, high: DataFrame, contain: bool, first_only: bool, inner: bool) -> DataFrame:
    """Matches between the names of earlier blocks and of later ones: company_id, type, known, k1, k2, name, o1, o2.

    ``first_only``: each name's first match per pair of blocks. ``inner``: both sides are blocks of one prefix, so a block
    meets itself and those before it.
    """
    a = low.select(*KEY, F.col("block").alias("b1"), F.col("names").alias("n1"), F.col("o1").alias("p1"), F.col("o2").alias("q1"),
                   F.col("low").alias("l1"), F.col("high").alias("h1"))
    b = high.select(*KEY, F.col("block").alias("b2"), F.col("names").alias("n2"), F.col("o1").alias("p2"), F.col("o2").alias("q2"),
                    F.col("low").alias("l2"), F.col("high").alias("h2"))
    pairs = a.join(b, KEY)
    if inner:
        pairs = pairs.filter("b1 <= b2")
    if not contain:
        t = THRESHOLD - 1e-9
        pairs = pairs.filter(f"2 * h1 >= {t} * (h1 + l2) AND 2 * h2 >= {t} * (h2 + l1)")

    def compare(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in table.to_pylist():
            x, y = Bags(r["n1"], contain), Bags(r["n2"], contain)
            every = np.arange(len(x.names))
            for j in range(len(y.names)):
                rows = every[:j] if inner and r["b1"] == r["b2"] else every
                for i in x.matches(y, j, rows):
                    out.append((r["company_id"], r["type"], x.names[i], r["p1"][i], r["q1"][i], y.names[j], r["p2"][j], r["q2"][j]))
                    if first_only:
                        break
        columns = list(zip(*out)) or [()] * 8
        types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 2
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                    names=["company_id", "type", "known", "k1", "k2", "name", "o1", "o2"])

    schema = "company_id string, type string, known string, k1 long, k2 long, name string, o1 long, o2 long"
    return pairs.groupBy(*KEY, "b1", "b2").applyInArrow(compare, schema)


def _decide(prefix: DataFrame, links: DataFrame) -> DataFrame:
    """(company_id, type, name, leader) of a prefix whose matches are the links (known before name)."""
    links = cut_lineage(links)
    open_, covered = links.select(*KEY, "known", "name"), None
    while not open_.isEmpty():
        # Earlier names that match nothing still open before them lead; what they match is covered.
        free = open_.join(open_.select(*KEY, F.col("name").alias("known")).distinct(), [*KEY, "known"], "left_anti")
        new = cut_lineage(free.select(*KEY, "name").distinct())
        covered = new if covered is None else covered.unionByName(new)
        left = open_.join(new, [*KEY, "name"], "left_anti")
        left = left.join(new.withColumnRenamed("name", "known"), [*KEY, "known"], "left_anti")
        open_ = cut_lineage(left)
    own = prefix.select(*KEY, "name", F.col("name").alias("leader"))
    if covered is None:
        return own
    leads = links.join(covered.withColumnRenamed("name", "known"), [*KEY, "known"], "left_anti").join(covered, [*KEY, "name"])
    first = leads.groupBy(*KEY, "name").agg(F.min_by("known", F.struct("k1", "k2")).alias("leader"))
    return own.join(covered, [*KEY, "name"], "left_anti").unionByName(first)


def greedy_leaders(names: DataFrame, contain: bool, block: int = BLOCK) -> DataFrame:
    """(company_id, type, name, leader) of greedy clustering in the order (o1, o2), unique per group.

    ``contain``: a name inside another matches too, and so an empty name matches all; otherwise it matches none.
    """
    names = cut_lineage(names.select(*KEY, "name", F.col("o1").cast("long").alias("o1"), F.col("o2").cast("long").alias("o2")))
    cut = F.struct("o1", F.floor(F.col("o2") / 65536).alias("c"))
    left = cut_lineage(running(names, KEY, ["o1", "o2"], cut, rank="rn"))

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o1", "ascending"), ("o2", "ascending")])
        values = table.column("name").to_pylist()
        leader = pa.array([values[i] for i in fold(values, contain)], pa.string())
        return table.select([*KEY, "name", "o1", "o2"]).append_column("leader", leader)

    schema = "company_id string, type string, name string, o1 long, o2 long, leader string"
    done = cut_lineage(left.filter(F.col("rn") <= block).groupBy(*KEY).applyInArrow(cluster, schema))
    left = left.filter(F.col("rn") > block)
    if left.isEmpty():
        return done.select(*KEY, "name", "leader")
    # Steps are files and read as one table: a union of checkpoints keeps what Spark knew about columns that they no longer
    # have, which breaks the plans of joins and filters above it.
    spark, folder, paths = names.sparkSession, scratch_path(names.sparkSession, "sitebrief-leaders"), []
    table = lambda *p: spark.read.schema("company_id string, type string, name string, leader string").parquet(*p)

    def stored(step: DataFrame) -> DataFrame:
        paths.append(f"{folder}/step{len(paths)}")
        step.select(*KEY, "name", "leader").write.parquet(paths[-1])
        return table(paths[-1])

    stored(done)
    size, leaders = block, done.filter("name = leader").select(*KEY, "name", "o1", "o2")
    while True:
        # Names that match a leader of the prefix before leave; the next prefix is as long as all before.
        numbered = running(leaders, KEY, ["o1", "o2"], cut, rank="rn")
        found = _meet(_blocks(numbered, block), _blocks(left, block), contain, True, False)
        found = stored(found.groupBy(*KEY, "name").agg(F.min_by("known", F.struct("k1", "k2")).alias("leader")))
        left = left.drop("rn").join(found.select(*KEY, "name"), [*KEY, "name"], "left_anti")
        left = cut_lineage(running(left, KEY, ["o1", "o2"], cut, rank="rn"))
        if left.isEmpty():
            break
        prefix = left.filter(F.col("rn") <= size)
        cells = _blocks(prefix, block)
        step = stored(_decide(prefix, _meet(cells, cells, contain, False, True)))
        leaders = prefix.join(step.filter("name = leader").select(*KEY, "name"), [*KEY, "name"], "left_semi").select(*KEY, "name", "o1", "o2")
        left = left.filter(F.col("rn") > size)
        size *= 2
    return table(*paths)
