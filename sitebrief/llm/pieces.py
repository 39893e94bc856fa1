"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments are laid end to end and indexed by a suffix array, as deep as the longest piece needs.
Every piece is found by binary search as a range of suffixes; the ranges become edges (start, end, piece), which are
sorted by end and relaxed: a position is reached by the one piece that goes with the piece before it.

For a BPE vocabulary "goes with" means that joining the two texts gives these two pieces again. A sequence whose
neighbours all go with each other is the BPE encoding of its text, and each prefix has one, so that relaxing finds
exactly what merging by score finds. Characters without a piece become byte pieces.

No piece joins a word and the blank after it, so texts are cut there, and a segment met before is not matched again.
A long segment (no blanks: encoded data, minified pages) is cut into blocks that overlap and are relaxed side by side,
each as if a text began at its overlap. A block stands if its overlap ends as the block before ends, over as many
positions as the longest piece has; all later positions follow from these. Any other block is relaxed again from there.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
# Sizes that bound a worker's memory; they decide speed only, not results.
CHUNK = 1 << 18  # bytes of distinct segments that are indexed together
PART = 1 << 20  # characters of texts that are encoded together
MEMORY = 40 << 20  # bytes that remembered segments and their ids take
BLOCK = 1024  # bytes of a long segment that are relaxed on their own
OVERLAP = 192  # bytes before a block that are relaxed with it
DEPTH = 16  # bytes of a suffix that are sorted; longer pieces are compared to their end


class Vocabulary:
    """Pieces and scores of a model file; what tasks need, nothing of the library's encoder."""

    def __init__(self, path: str = MODEL):
        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i]}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.control = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}


def steps_of(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """BPE of a short text: join the neighbours with the best score, the leftmost first, until none can be joined.

    Returns the parts, and for each step its score and the first and last part after it.
    """
    parts, steps = list(text), []
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        steps.append((best, sys.intern(parts[0]), sys.intern(parts[-1])))
    return parts, steps


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # Pieces that merging can reach, in byte form; a blank is one byte here, as the text holds none.
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        reach = []
        for text, i in vocabulary.ids.items():
            parts, self.steps[i] = steps_of(text, vocabulary.scores)
            if parts == [text]:
                reach.append((self._raw(text), i))
        reach.sort()
        self.raw, self.raw_ids = [r for r, _ in reach], np.array([i for _, i in reach], np.int32)
        self.lengths = np.array([len(r) for r in self.raw], np.int32)
        self.longest = max([4, *self.lengths.tolist()])
        self.low = np.array([r[:DEPTH] for r in self.raw], f"S{DEPTH}")
        # The range of a piece ends before the least key above all that begin with it.
        self.above = np.array([r[:DEPTH] + b"\xff" * (DEPTH - len(r)) for r in self.raw], f"S{DEPTH}")
        self.cuts = all(BLANK not in t.lstrip(BLANK) for t in vocabulary.ids)
        self.segment = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.strange: dict[str, int] = {}  # characters without a piece: numbers after the ids
        self.names = dict(enumerate(vocabulary.texts))
        self.widths = [len(self._raw(t)) for t in vocabulary.texts]
        self.slot_pair, self.slot_fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.seen: dict[str, bytes] = {}  # ids, 4 bytes each
        self.held = 0  # bytes of memory that ``seen`` takes, about

    @staticmethod
    def _raw(text: str) -> bytes:
        return text.replace(BLANK, " ").encode("utf-8", "surrogatepass")

    def goes_with(self, a: int, b: int) -> bool:
        """Whether merging the joined texts gives the two pieces again: no step across the border comes first.

        Both sides take their own steps, the better score first and the left one on a tie; a step across is taken when
        it beats the next step of either side.
        """
        scores, left, right = self.v.scores, self.steps.get(a, ()), self.steps.get(b, ())
        x, y, i, j, fits = self.names[a][-1], self.names[b][0], 0, 0, True
        while True:
            across = scores.get(x + y)
            one = left[i][0] if i < len(left) else None
            two = right[j][0] if j < len(right) else None
            if across is not None and (one is None or across > one) and (two is None or across >= two):
                fits = False
                break
            if one is None and two is None:
                break
            if two is None or (one is not None and one >= two):
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1
        return fits

    def all_fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """goes_with for many pairs: each is worked out once and kept in its slot of a table of fixed size."""
        pairs = (before.astype(np.int64) << 21) | piece
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out, known = self.slot_fits[slot], self.slot_pair[slot] == pairs
        if not known.all():
            new, where = np.unique(pairs[~known], return_inverse=True)
            fits = np.array([self.goes_with(p >> 21, p & 0x1FFFFF) for p in new.tolist()], bool)
            out[~known] = fits[where]
            slot = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            # Two new pairs can share a slot; the last of both arrays stays, so they agree.
            self.slot_pair[slot] = new
            self.slot_fits[slot] = fits
        return out

    # --- matching

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece."""
        text = np.frombuffer(data + bytes(DEPTH), np.uint8)
        n = len(data)
        suffix = np.lib.stride_tricks.sliding_window_view(text, DEPTH)[:n]
        keys = np.ascontiguousarray(suffix)
        words = keys.view(">u8")
        order = np.lexsort((words[:, 1].astype(np.uint64), words[:, 0].astype(np.uint64))).astype(np.int32)
        keys = keys[order].reshape(-1).view(f"S{DEPTH}")
        first = np.searchsorted(keys, self.low, "left")
        sizes = np.searchsorted(keys, self.above, "right") - first
        del keys, words
        found = np.flatnonzero(sizes)
        first, sizes = first[found], sizes[found]
        at = np.repeat((first - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        start, which = order[at], np.repeat(found.astype(np.int32), sizes)
        del at
        keep = None
        for k in found[self.lengths[found] > DEPTH].tolist():
            keep = np.ones(len(which), bool) if keep is None else keep
            for i in np.flatnonzero(which == k).tolist():
                keep[i] = data[start[i]:start[i] + self.lengths[k]] == self.raw[k]
        if keep is not None:
            start, which = start[keep], which[keep]
        return start, start + self.lengths[which], self.raw_ids[which]

    # --- relaxing

    def relax(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The last piece of every prefix of each of the byte strings: (best, bounds, edges by segment end).

        ``best`` runs over the strings laid end to end, a closing byte behind each; ``bounds`` are their ends. A prefix
        of p bytes stands at p from its string's start; where a character is not complete there is -1.
        """
        data = b"\x00".join(raws) + b"\x00"
        text = np.frombuffer(data, np.uint8)
        start, end, piece = self.edges(data)
        # Characters that no piece of one character matches are edges of their own.
        leads = np.flatnonzero((text & 0xC0) != 0x80)
        ends = np.append(leads[1:], len(data))
        single = np.zeros(len(data) + 1, bool)
        width = np.zeros(len(data) + 1, np.int32)
        width[leads] = ends - leads
        single[start[(end - start) == width[start]]] = True
        bounds = np.cumsum([len(r) + 1 for r in raws])
        closing = np.zeros(len(data), bool)
        closing[bounds - 1] = True
        odd = np.flatnonzero(~single[leads] & ~closing[leads])
        if len(odd):
            start, end = np.append(start, leads[odd].astype(np.int32)), np.append(end, ends[odd].astype(np.int32))
            piece = np.append(piece, np.array([self._strange(data[leads[i]:ends[i]]) for i in odd], np.int32))
        # Edges by the distance of their end from their string's start: all strings are relaxed side by side.
        heads = np.concatenate([[0], bounds[:-1]]).astype(np.int32)
        head = heads[np.searchsorted(bounds, end, "left")]
        gone = end - head
        order = np.argsort(gone, kind="stable")
        start, end, piece, gone = start[order], end[order], piece[order], gone[order]
        first = start == head[order]
        steps = np.flatnonzero(np.diff(gone, prepend=-1))
        best = np.full(len(data) + 1, -1, np.int32)
        for a, b in zip(steps, np.append(steps[1:], len(end))):
            s, e, p, ok = start[a:b], end[a:b], piece[a:b], first[a:b].copy()
            inner = np.flatnonzero(~ok & (best[s] >= 0))
            if len(inner):
                ok[inner] = self.all_fit(best[s[inner]], p[inner])
            best[e[ok]] = p[ok]
        return best, bounds, (start, end, piece)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments together."""
        raws = [self._raw(s) for s in segments]
        best, bounds, _ = self.relax(raws)
        best, at = best.tolist(), 0
        for segment, bound in zip(segments, bounds.tolist()):
            ids = array("i", self._chain(best, at, bound - 1)).tobytes()
            self.seen[segment] = ids
            self.held += 250 + 2 * len(segment) + len(ids)
            at = bound

    def _chain(self, best: list[int], start: int, end: int) -> list[int]:
        out, widths = [], self.widths
        while end > start:
            p = best[end]
            out.append(p)
            end -= widths[p]
        out.reverse()
        return self._ids(out) if self.strange else out

    def long(self, segment: str) -> bytes:
        """The ids of a segment of more than one block."""
        raw = self._raw(segment)
        cuts = [0]
        while cuts[-1] < len(raw):
            c = min(cuts[-1] + BLOCK, len(raw))
            while c < len(raw) and raw[c] & 0xC0 == 0x80:
                c += 1
            cuts.append(c)
        whole = np.full(len(raw) + 1, -1, np.int32)
        group = max(1, CHUNK // (BLOCK + OVERLAP))
        for k in range(0, len(cuts) - 1, group):
            blocks = []
            for a, b in zip(cuts[k:k + group], cuts[k + 1:k + group + 1]):
                z = max(a - OVERLAP, 0)
                while z and raw[z] & 0xC0 == 0x80:
                    z -= 1
                blocks.append((z, a, b))
            best, bounds, edges = self.relax([raw[z:b] for z, _, b in blocks])
            by_end = None
            for (z, a, b), bound in zip(blocks, bounds.tolist()):
                here = best[bound - 1 - (b - z):bound]  # prefixes that end at z ... b
                known = slice(max(a - self.longest, 0) + 1, a + 1)
                if z == 0 or np.array_equal(whole[known], here[known.start - z:a + 1 - z]):
                    whole[a + 1:b + 1] = here[a + 1 - z:]
                    continue
                if by_end is None:
                    order = np.argsort(edges[1], kind="stable")
                    by_end = [x[order] for x in edges]
                shift = bound - 1 - b
                lo, hi = np.searchsorted(by_end[1], [a + 1 + shift, b + shift + 1])
                self._again(whole, *[x[lo:hi] for x in by_end], shift)
        return array("i", self._chain(whole.tolist(), 0, len(raw))).tobytes()

    def _again(self, whole: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, shift: int) -> None:
        """Relax the edges of one block one by one, from what is known of the text before."""
        low = int(start.min()) - shift
        known, fits = whole[low:int(end.max()) - shift + 1].tolist(), {}
        for s, e, p in zip((start - shift - low).tolist(), (end - shift - low).tolist(), piece.tolist()):
            before = known[s]
            if before < 0:
                continue
            ok = fits.get((before, p))
            if ok is None:
                ok = fits[before, p] = self.goes_with(before, p)
            if ok:
                known[e] = p
        whole[low:low + len(known)] = known

    def _strange(self, raw: bytes) -> int:
        char = raw.decode("utf-8", "surrogatepass")
        number = self.strange.setdefault(char, len(self.v.texts) + len(self.strange))
        if number not in self.names:
            self.names[number] = char
            self.widths.append(len(raw))
        return number

    def _ids(self, numbers: list[int]) -> list[int]:
        size = len(self.v.texts)
        if max(numbers) < size:
            return numbers
        out: list[int] = []
        for x in numbers:
            out += [x] if x < size else [self.v.byte_ids[b] for b in self.names[x].encode("utf-8", "surrogatepass")]
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of some texts; an empty text has none."""
        cut = []
        for text in texts:
            whole = BLANK + text.replace(" ", BLANK) if text else ""
            cut.append(self.segment.findall(whole) if self.cuts else [whole] if whole else [])
        wanted = {s for c in cut for s in c}
        if self.held > MEMORY:
            self.seen = {s: self.seen[s] for s in wanted if s in self.seen}
            self.held = sum(250 + 2 * len(s) + len(i) for s, i in self.seen.items())
        seen, big = self.seen, {}
        part, size = [], 0
        for s in wanted - seen.keys():
            if len(s) > BLOCK:
                big[s] = self.long(s)
                continue
            part.append(s)
            size += len(s)
            if size >= CHUNK:
                self.learn(part)
                part, size = [], 0
        if part:
            self.learn(part)
        return [np.frombuffer(b"".join([big[s] if s in big else seen[s] for s in c]), np.int32) for c in cut]


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of some rows of a batch, about PART characters at a time."""
    keys, texts, size = [], [], 0
    for i in range(batch.num_rows):
        keys.append(batch.column(0)[i].as_py())
        texts.append(batch.column(1)[i].as_py() or "")
        size += len(texts[-1])
        if size >= PART:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder: tasks of one worker share what it remembers."""
    if vocabulary.path not in _ENCODERS:
        _ENCODERS[vocabulary.path] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.path]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.raw = [t.replace(BLANK, " ").encode("utf-8", "surrogatepass") for t in vocabulary.texts]
        for b, i in enumerate(vocabulary.byte_ids):
            self.raw[i] = bytes([b])
        for i in vocabulary.control:
            self.raw[i] = b""

    def decode(self, ids: Iterable[int]) -> str:
        """The text; the blank that encoding puts in front goes."""
        raw = self.raw
        whole = b"".join([raw[i] for i in ids])
        try:
            text = whole.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = whole.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids: one row per row.

    A null or empty text has no ids; repeated rows and ids stay rows of their own and are encoded alike; each text has one
    encoding, so there are no ties; an empty table gives an empty one; other columns are ignored.
    """
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for keys, texts in parts_of(batch):
                ids = encoder.encode(texts)
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["doc_id", "n_tokens", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [None if i is None else decoder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_table(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: n_tokens, n_byte_tokens, ids_sha256 (ids as 4 bytes each, low byte first), decoded_sha256, round_trip.

    ``round_trip``: decoding the ids gives the text (with the vocabulary's blank sign read as a blank). Null, empty and
    repeated rows, an empty table and other columns are as in ``encode_documents``.
    """
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, is_byte = encoder_of(vocabulary), Decoder(vocabulary), np.zeros(len(vocabulary.texts), bool)
        is_byte[vocabulary.byte_ids] = True
        for batch in batches:
            for keys, texts in parts_of(batch):
                rows = []
                for text, ids in zip(texts, encoder.encode(texts)):
                    back = decoder.decode(ids.tolist())
                    rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                                 hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(BLANK, " ")))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64())] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
