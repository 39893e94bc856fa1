"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere else. Suffixes are told apart only as far
as ``size`` bytes, by passes over ever longer digits; suffixes that are alone in their group leave, and the groups that
are left at full depth are exactly the repeated strings. Two things keep the passes small:

* Only some suffixes are sorted. Each string of ``size`` bytes has an anchor, the place of its least k-gram hash; equal
  strings have their anchor at the same place. About one place in 90 is an anchor.
* All strings around an anchor go through the passes together. The first digit is the anchor's own k-gram, which all of
  them hold. If all bytes that they cover together are found twice, all of them are repeated. Only anchors at the edges
  of repeated passages stay open. They fetch their surroundings, and their single strings are compared in groups of
  bounded size; a larger group is dealt out by longer digits first, half of the strings at a time.

Digits are 64-bit hashes, and each comparison is made within the group of the digits before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.llm.common import written
from sitebrief.llm.hashing import BASE, TABLE, mix, powers

SIZE, GRAM = 200, 24
CHUNK = 1 << 20  # bytes that are hashed at a time
PIECE = 1 << 22  # longer texts are worked in overlapping pieces; positions need 24 bits
GROUP = 4096  # open anchors of a group that are compared at once
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)


class Rolling:
    """Hashes of any part of a byte array."""

    def __init__(self, data: np.ndarray):
        up = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * up[:-1], out=self.total[1:])
        self.down = powers(len(data) + 1, _INVERSE)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of the least, the leftmost of equal ones; places are below 2**24."""
    least = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    return (least & _PLACE).astype(np.int64)


def anchors(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, place, first digit, hash of all that strings around the anchor cover), by text and place.

    The texts stand end to end; strings that cross a border are left out.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    none = np.empty(0, np.int64)
    if len(data) < size:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    place = least_places(rolling.part(at, at + gram), size - gram + 1)
    window = np.arange(len(place))
    owner = np.searchsorted(ends, window, "right")
    place, owner = place[ok := window + size <= ends[owner]], owner[ok]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    place, owner = place[new], owner[new]
    low, high = np.maximum(starts[owner], place - (size - gram)), np.minimum(ends[owner], place + size)
    shape = ((place - low) * (2 * size) + (high - place)).astype(np.uint64)
    return owner, place - starts[owner], rolling.part(place, place + gram), mix(rolling.part(low, high) ^ mix(shape))


def _pieces(raw: bytes, size: int, length: int | None = None) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces; each string and its surroundings lie whole in one of them."""
    length = length or PIECE
    for at in range(0, max(1, len(raw) - 3 * size), length - 4 * size):
        yield at, raw[at:at + length]


def _own(base: int, n: int, size: int, length: int) -> tuple[int, int, int]:
    """base, and the places (first, end) whose anchors the piece at ``base`` tells in a text of ``n`` bytes. Each place
    belongs to one piece, and all strings around it lie whole in that piece."""
    step = length - 4 * size
    last = base + step >= n - 3 * size
    return base, base + 2 * size if base else 0, n if last else base + 2 * size + step


def _scan(documents: DataFrame, size: int, gram: int) -> DataFrame:
    """Anchors: uid, place, digit, cover, n. Those of a text that are alike are sent once with their number (n, 2 at
    most); ``own`` rows are the places that the text itself repeats. Of the pieces of a long text each tells the anchors
    of its own places only, so that none is counted twice."""
    chunk, length = CHUNK, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, bounds, texts in _parts(batch, size, chunk, length):
                owner, place, digit, cover = anchors(texts, size, gram)
                base, low, high = np.array(bounds, np.int64)[owner].T
                place = place + base
                inside = (place >= low) & (place < high)
                owner, place, digit, cover = owner[inside], place[inside], digit[inside], cover[inside]
                uid = np.array(uids, np.int64)[owner] if len(owner) else np.empty(0, np.int64)
                order = np.lexsort((place, cover, digit, uid))
                uid, place, digit, cover = uid[order], place[order], digit[order], cover[order]
                first = np.flatnonzero((np.diff(uid, prepend=0) != 0) | (np.diff(digit, prepend=np.uint64(0)) != 0)
                                       | (np.diff(cover, prepend=np.uint64(0)) != 0) | (np.arange(len(uid)) == 0))
                n = np.diff(np.append(first, len(uid)))
                again = np.repeat(n > 1, n)
                yield _anchor_batch(uid[first], place[first], digit[first], cover[first], np.minimum(n, 2), False)
                yield _anchor_batch(uid[again], place[again], digit[again], cover[again], np.full(again.sum(), 2), True)

    return documents.mapInArrow(run, "uid long, place long, digit long, cover long, n long, own boolean")


def _anchor_batch(uid, place, digit, cover, n, own) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(uid, pa.int64()), pa.array(place, pa.int64()), pa.array(digit.view(np.int64)), pa.array(cover.view(np.int64)),
         pa.array(n, pa.int64()), pa.array(np.full(len(uid), own), pa.bool_())], names=["uid", "place", "digit", "cover", "n", "own"])


def _parts(batch: pa.RecordBatch, size: int, chunk: int, length: int) -> Iterator[tuple[list, list, list]]:
    uids, bounds, texts, held = [], [], [], 0
    for uid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        for base, piece in _pieces(raw, size, length):
            uids.append(uid)
            bounds.append(_own(base, len(raw), size, length))
            texts.append(piece)
            held += len(piece)
            if held >= chunk:
                yield uids, bounds, texts
                uids, bounds, texts, held = [], [], [], 0
    if texts:
        yield uids, bounds, texts


def _sorted_out(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One pass. rows: uid, place, digit, cover, n and more. Returns (rows whose whole cover is repeated, open rows).

    Rows that are alone with their digit leave. The open rows are one of each cover, where a digit has several covers;
    ``covers`` is their number.
    """
    # Sums are written before they are joined: a join of two plain tables is split where a digit is hot.
    digits = written(rows.groupBy("digit").agg(F.sum("n").alias("_all")).filter("_all > 1"), f"{name}-digits")
    alive = written(rows.join(digits, "digit").drop("_all"), f"{name}-alive")
    covers = written(alive.groupBy("digit", "cover").agg(
        F.sum("n").alias("_same"), F.min(F.struct("uid", "place")).alias("_one")), f"{name}-covers")
    number = written(covers.groupBy("digit").agg(F.count("*").alias("covers")), f"{name}-numbers")
    known = covers.join(number, "digit").filter("_same > 1 OR covers > 1")
    known = written(alive.join(written(known, f"{name}-classes"), ["digit", "cover"]), f"{name}-known")
    repeated = known.filter("_same > 1")
    opened = known.filter((F.col("covers") > 1) & ((F.col("_same") == 1) | (F.struct("uid", "place") == F.col("_one"))))
    return repeated, opened.drop("_same", "_one", "n", "cover")


def _surroundings(documents: DataFrame, opened: DataFrame, size: int, gram: int) -> DataFrame:
    """Adds the bytes around each open anchor (``near``) and the anchor's place in them (``at``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid, raw, points = (batch.column(k)[i].as_py() for k in range(3))
                low = [max(0, p["place"] - (size - gram)) for p in points]
                yield pa.RecordBatch.from_arrays([
                    pa.array([uid] * len(points), pa.int64()), pa.array([p["place"] for p in points], pa.int64()),
                    pa.array([p["digit"] for p in points], pa.int64()), pa.array([p["covers"] for p in points], pa.int64()),
                    pa.array([raw[a:p["place"] + size] for a, p in zip(low, points)], pa.binary()),
                    pa.array([p["place"] - a for a, p in zip(low, points)], pa.int32())],
                    names=["uid", "place", "digit", "covers", "near", "at"])

    points = opened.groupBy("uid").agg(F.collect_list(F.struct("place", "digit", "covers")).alias("points"))
    return documents.dropDuplicates(["uid"]).join(points, "uid").select("uid", "raw", "points").mapInArrow(
        run, "uid long, place long, digit long, covers long, near binary, at int")


def _halves(rows: DataFrame, size: int) -> DataFrame:
    """Each row's strings in two halves, with their next digit (what all strings of a half hold) and cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = batch_names = ["uid", "place", "digit", "near", "at", "first", "last"]
        for batch in batches:
            out = {n: [] for n in [*names, "cover"]}
            for uid, place, digit, near, at, first, last in zip(*(batch.column(n).to_pylist() for n in batch_names)):
                middle = (first + last) // 2
                for a, b in {(first, middle), (min(middle + 1, last), last)}:
                    # A string begins r bytes before the anchor, r from a to b, as far as the text reaches.
                    low, high = max(a, size - (len(near) - at)), min(b, at)
                    if low > high:
                        continue
                    core = hashlib.blake2b(near[at - a:at - b + size], digest_size=8, key=f"{digit}:{a}:{b}".encode()).digest()
                    cover = near[at - high:at - low + size]
                    whole = hashlib.blake2b(cover, digest_size=8, key=f"{low}:{high}".encode()).digest()
                    for n, v in zip(out, (uid, place, int.from_bytes(core, "little", signed=True), near, at, a, b,
                                          int.from_bytes(whole, "little", signed=True))):
                        out[n].append(v)
            types = dict(near=pa.binary(), at=pa.int32(), first=pa.int32(), last=pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in out.items()], names=list(out))

    return rows.select("uid", "place", "digit", "near", "at", "first", "last").mapInArrow(
        run, "uid long, place long, digit long, near binary, at int, first int, last int, cover long")


def _compared(rows: DataFrame, size: int) -> DataFrame:
    """uid, start, end: repeated strings (first and last start) among the rows of each digit, string by string."""
    def marks(table: pa.Table) -> pa.RecordBatch:
        column = lambda n: table.column(n).to_numpy()
        near = table.column("near").to_pylist()
        uid, place, digit, at, first, last = (column(n) for n in ("uid", "place", "digit", "at", "first", "last"))
        ends = np.cumsum([len(x) for x in near])
        begin = ends - [len(x) for x in near]
        rolling = Rolling(np.frombuffer(b"".join(near), np.uint8))
        found = np.zeros((len(near), int(last.max()) + 2), bool)
        group = np.unique(digit, return_inverse=True)[1]
        for r in range(int(first.min()), int(last.max()) + 1):
            start = begin + at - r
            rows = np.flatnonzero((r >= first) & (r <= last) & (start >= begin) & (start + size <= ends))
            if len(rows) < 2:
                continue
            key = rolling.part(start[rows], start[rows] + size)
            order = np.lexsort((key, group[rows]))
            same = (np.diff(key[order]) == 0) & (np.diff(group[rows][order]) == 0)
            twice = np.append(same, False) | np.append(False, same)
            found[rows[order[twice]], r] = True
        edge = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(place[row] - (high - 1)), pa.array(place[row] - low)],
                                          names=["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP:
                continue
            table = pa.Table.from_batches(held)
            digit = table.column("digit").to_numpy()
            cut = int(np.searchsorted(digit, digit[-1], "left"))  # the last group may go on
            if cut:
                yield marks(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield marks(pa.Table.from_batches(held))

    return (rows.select("uid", "place", "digit", "near", "at", "first", "last").repartition("digit")
            .sortWithinPartitions("digit").mapInArrow(run, "uid long, start long, end long"))


def _with_uid(documents: DataFrame) -> DataFrame:
    """uid, raw, doc_id: rows with equal id and text share a uid and each other's result."""
    return documents.select(F.xxhash64("doc_id", "text").alias("uid"),
                            F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"), "doc_id")


def repeated_strings(documents: DataFrame, size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """uid, start, end: strings of ``size`` bytes that start at start..end (inclusive) are repeated. Ranges overlap."""
    rows = _with_uid(documents)
    scanned = _scan(rows.select("uid", "raw"), size, gram)
    repeated, opened = _sorted_out(scanned.filter("NOT own").drop("own"), "suffix")
    around = lambda df: df.select("uid", (F.col("place") - (size - gram)).alias("start"), F.col("place").alias("end"))
    parts = [around(scanned.filter("own")), around(repeated)]
    state = written(_surroundings(rows, opened, size, gram), "suffix-open").withColumns(
        {"first": F.lit(0), "last": F.lit(size - gram)})
    while True:
        parts.append(_compared(state.filter(F.col("covers") <= group), size))
        large = state.filter(F.col("covers") > group)
        if large.limit(1).count() == 0:
            break
        repeated, opened = _sorted_out(_halves(large, size).withColumn("n", F.lit(1).cast("bigint")), "suffix-half")
        parts.append(repeated.select("uid", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first")).alias("end")))
        # Half ranges of one string are settled by their covers.
        state = opened.filter("first < last")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _cleaned(documents: DataFrame, size: int, options: dict, ddl: str, describe, types: list) -> DataFrame:
    """Apply ``describe(raw, removed mask)`` to each document."""
    ranges = repeated_strings(documents, size, **options).groupBy("uid").agg(
        F.collect_set(F.struct("start", "end")).alias("ranges")).withColumnRenamed("uid", "_uid")
    rows = _with_uid(documents)
    both = rows.join(ranges, rows["uid"] == F.col("_uid"), "left").select("doc_id", "raw", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw, found = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                change = np.zeros(len(raw) + 1, np.int32)
                if found:
                    start = np.maximum(0, [r["start"] for r in found])
                    end = np.minimum(len(raw), np.array([r["end"] for r in found]) + size)
                    np.add.at(change, start, 1)
                    np.add.at(change, end, -1)
                out.append(describe(raw, np.cumsum(change[:-1]) > 0))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             names=["doc_id", *(str(i) for i in range(len(types)))])

    return both.mapInArrow(run, ddl)


def _digest(raw: bytes, removed: np.ndarray) -> tuple:
    kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
    spans = int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())
    return len(raw), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()


def repeats_table(documents: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """One row per row of ``documents``: n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts shorter than ``size`` lose nothing; repeated rows repeat each other and lose all
    strings; other columns are ignored; an empty table gives no rows.
    """
    return _cleaned(documents, size, options, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                    _digest, [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def remove_repeats(documents: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """doc_id and the text that is left; bytes of characters that were cut in part go too."""
    def left(raw: bytes, removed: np.ndarray) -> tuple:
        return (np.frombuffer(raw, np.uint8)[~removed].tobytes().decode("utf-8", "ignore"),)
    return _cleaned(documents, size, options, "doc_id long, text string", left, [pa.string()])
