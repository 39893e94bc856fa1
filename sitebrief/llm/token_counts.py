"""Token counts by a two-tier lookup on the map side: no pre-token is shuffled.

A text is cut into pre-tokens, a word with the blanks before it; no piece joins a word and the blank after it, so the
tokens of a text are those of its pre-tokens. The first tier is a compact table of frequent pre-tokens and their
lengths in tokens, broadcast to all tasks. The second is a cache in each worker: what misses both is encoded there by
the tokenizer's library, many at a time.

Both tiers decide speed only. The table is fitted on a bounded sample (at most ``SHARDS`` tasks read at most ``SAMPLE``
characters each and report their ``REPORT`` most frequent pre-tokens) and holds at most ``ENTRIES`` pre-tokens of at
most ``WIDEST`` characters; the cache holds at most ``CACHE`` bytes.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.llm import pieces

ENTRIES = 32_768
WIDEST = 48
SHARDS = 64
SAMPLE = 1 << 20
REPORT = 8_192
CACHE = 32 << 20
LONG = 1 << 16  # characters of a pre-token that go to the library at once; longer ones are encoded in blocks
LIMIT = 4096  # tokens

_PRETOKEN = re.compile(" *[^ ]+| +")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the blank that the tokenizer puts in front; none of an empty text."""
    return _PRETOKEN.findall(" " + text.replace(pieces.BLANK, " ")) if text else []


class Lengths(dict):
    """Token counts by pre-token; both tiers answer like a dictionary, a miss fills the second."""

    def __init__(self, frequent: pa.RecordBatch | None, model: str):
        super().__init__()
        self.frequent = dict(zip(*[c.to_pylist() for c in frequent.columns])) if frequent else {}
        self.update(self.frequent)
        self.model = model
        self.held = 0
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.blocks: pieces.Encoder | None = None

    def learn(self, new: Iterable[str]) -> None:
        """Encode what neither tier has. The library puts the first blank in front itself, but not alone."""
        new = list(new)
        if " " in new:
            self[" "] = len(self.library.encode("a ")) - len(self.library.encode("a"))
            new.remove(" ")
        short = [w for w in new if len(w) <= LONG]
        for word, ids in zip(short, self.library.encode([w[1:] for w in short], num_threads=1)):
            self[word] = len(ids)
        for word in new:
            if len(word) > LONG:
                self.blocks = self.blocks or pieces.Encoder(pieces.Vocabulary(self.model))
                self[word] = sum(len(i) for i in self.blocks.encode([word[1:]]))
        self.held += sum(150 + 2 * len(w) for w in new)

    def shrink(self) -> None:
        """Empty the second tier when it has grown too large."""
        if self.held > CACHE:
            self.clear()
            self.update(self.frequent)
            self.held = 0

    def count(self, texts: list[str]) -> list[int]:
        cut = [pretokens(t) for t in texts]
        self.learn({w for c in cut for w in c if w not in self})
        get = self.__getitem__
        return [sum(map(get, c)) for c in cut]


def frequent_pretokens(documents: DataFrame, model: str = pieces.MODEL) -> pa.RecordBatch:
    """The first tier: (pretoken, n_tokens) of at most ENTRIES frequent pre-tokens of a bounded sample."""
    step = max(1, -(-documents.rdd.getNumPartitions() // SHARDS))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % step:
            return
        found, left = Counter(), SAMPLE
        for batch in batches:
            for _, texts in pieces.parts_of(batch):
                for text in texts:
                    found.update(w for w in pretokens(text[:left]) if len(w) <= WIDEST)
                    left -= len(text)
                    if left <= 0:
                        break
                if left <= 0:
                    break
            if left <= 0:
                break
        words = found.most_common(REPORT)
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array([w for w, _ in words], pa.string()),
                                          "n": pa.array([n for _, n in words], pa.int64())})

    counts = documents.select("doc_id", "text").mapInArrow(sample, "pretoken string, n long")
    best = counts.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(ENTRIES)
    words = best.select("pretoken").toArrow().column(0).to_pylist()
    lengths = Lengths(None, model)
    lengths.learn(words)
    return pa.RecordBatch.from_pydict({"pretoken": pa.array(words, pa.string()),
                                       "n_tokens": pa.array([lengths[w] for w in words], pa.int32())})


_WORKER: dict[str, Lengths] = {}


def lengths_of(name: str, frequent: bytes, model: str) -> Lengths:
    """The worker's tiers for one job: its tasks share what they have learnt."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Lengths(pa.ipc.open_stream(frequent).read_next_batch(), model)
    return _WORKER[name]


def token_table(documents: DataFrame, model: str = pieces.MODEL) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than LIMIT tokens): one row per row, in one map.

    A null or empty text has no bytes and no tokens; repeated rows and ids stay rows of their own; an empty table gives
    an empty one; other columns are ignored. No begin, end or added tokens; special strings in texts are plain text.
    """
    frequent, sink = frequent_pretokens(documents, model), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as out:
        out.write_batch(frequent)
    table = documents.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(name, table.value, model)
        for batch in batches:
            counts = []
            for _, texts in pieces.parts_of(batch):
                lengths.shrink()
                counts += lengths.count(texts)
            n_tokens = pa.array(counts, pa.int64())
            n_bytes = pc.binary_length(pc.fill_null(batch.column(1), "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), n_bytes, n_tokens, pc.greater(n_tokens, LIMIT)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
