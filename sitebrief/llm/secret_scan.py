"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

The guess cost of a value is the least sum of bits over all ways to cut it into words, dates, repeats, keyboard walks
and brute-force spans. It is found by dynamic programming over the value's positions; each position looks back over a
bounded number of cuts, so time is linear in the value. A value that costs enough guesses is a secret, a placeholder
such as ``changeme123`` is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitebrief.llm.common import map_texts

# The base patterns of the contract, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# Values beside these names are judged by their guess cost. A value begins where the match ends.
_SIGN = "[!#$%&(-;=?-_a-~]"
CONTEXT = re.compile(
    r"""(?i:password|passwd|passphrase|pwd|secret|token|credential|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer)"""
    r"""(?i:[\x20_-]?(?:key|token|secret|password|passwd|pwd|access|auth|base|value|string|hash|id)|[_-]?[0-9]){0,4}"""
    r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|\x20+)["'`]?(?=""" + _SIGN + ")")
VALUE = re.compile(_SIGN + "+")
TRIM = ",;:.)]}#&%$*!"

# Frequent words of passwords and placeholders, by rank.
WORDS = (
    "password pass admin test user login welcome secret token letmein monkey dragon master qwerty abc hello love money "
    "god sex sunshine princess football baseball shadow superman batman iloveyou trustno michael jordan harley hunter "
    "ranger buster soccer hockey killer george charlie andrew michelle jessica pepper daniel access flower mustang "
    "changeme change default example sample demo temp guest root server system service client public private key api "
    "your my the here value name none null true false empty foo bar baz todo placeholder insert replace enter xxx "
    "redacted hidden masked string text data config local dev prod stage testing company office home summer winter "
    "spring autumn january february march april may june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$57!8", "aaeiossti" + "b")

_DATE = re.compile(r"(?:(?:19|20)\d\d[-./_]?(?:0?[1-9]|1[0-2])[-./_]?(?:0?[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])[-./_]?(?:0?[1-9]|1[0-2])[-./_]?(?:19|20)\d\d|(?:19|20)\d\d)")
DATE_BITS = {True: math.log2(365 * 120), False: math.log2(120)}  # a day, a year


def keyboard_neighbours() -> set[tuple[str, str]]:
    """Pairs of keys that touch: in a row, and slanting between rows."""
    pairs = set()
    for row in KEY_ROWS:
        pairs |= set(zip(row, row[1:]))
    for upper, lower in zip(KEY_ROWS[0][1:], KEY_ROWS[1]):
        pairs.add((upper, lower))
    for above, below in zip(KEY_ROWS[1:], KEY_ROWS[2:]):
        pairs |= set(zip(above, below)) | set(zip(above[1:], below))
    return pairs | {(b, a) for a, b in pairs}


def _brute_bits(char: str) -> float:
    """Bits of one character by brute force: of its own class; separators between words are cheap."""
    if char in "_-.":
        return 2.0
    return math.log2(26 if char.isalpha() else 10 if char.isdigit() else 33)


class GuessCost:
    """``GuessCost()(value)``: least number of guesses in bits. ``words`` can be a longer list, by rank."""

    def __init__(self, words: Iterable[str] = WORDS):
        self.rank = {}
        for w in words:
            self.rank.setdefault(w.lower(), len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.touch = keyboard_neighbours()

    def __call__(self, value: str) -> float:
        n = len(value)
        if not n:
            return 0.0
        low = value.lower()
        plain = low.translate(LEET)
        bits_of = [_brute_bits(c) for c in value]
        # Runs that end at i: equal characters, steps of one (abc, 321), neighbours on the keyboard.
        runs = {"same": [1] * n, "step": [1] * n, "walk": [1] * n}
        for i in range(1, n):
            d = ord(low[i]) - ord(low[i - 1])
            if d == 0:
                runs["same"][i] = runs["same"][i - 1] + 1
            if abs(d) == 1:
                before = i >= 2 and ord(low[i - 1]) - ord(low[i - 2]) == d
                runs["step"][i] = runs["step"][i - 1] + 1 if before else 2
            if (low[i - 1], low[i]) in self.touch:
                runs["walk"][i] = runs["walk"][i - 1] + 1
        # period[p]: how long the text that ends here has been repeating the p characters before.
        period = [0] * 17
        dates: dict[int, list[tuple[int, float]]] = {}
        for m in (m for i in range(n) if low[i].isdigit() for m in [_DATE.match(low, i)] if m):
            dates.setdefault(m.end(), []).append((m.start(), DATE_BITS[m.end() - m.start() > 4]))
        best = [0.0] * (n + 1)
        for end in range(1, n + 1):
            char = bits_of[end - 1]
            cost = best[end - 1] + char  # one more character by brute force
            for start in range(max(0, end - self.longest), end - 1):
                for form, extra in ((low[start:end], 0.0), (plain[start:end], 1.0)):
                    rank = self.rank.get(form)
                    if rank:
                        capital = 0.0 if value[start:end].islower() else 1.0 if value[start + 1:end].islower() else 2.0
                        cost = min(cost, best[start] + math.log2(rank) + 1 + capital + extra)
            # A run begins at its start, or behind a word that ends in it; words are short.
            for kind, bits in (("same", char), ("step", char + 1), ("walk", char + 2)):
                first = end - runs[kind][end - 1]
                for start in range(first, min(first + self.longest, end - 3) + 1):
                    cost = min(cost, best[start] + bits + math.log2(end - start))
            for start, bits in dates.get(end, ()):
                cost = min(cost, best[start] + bits)
            for size in range(2, min(16, end - 1) + 1):  # a block that comes again and again
                period[size] = period[size] + 1 if low[end - 1] == low[end - 1 - size] else 0
                first = end - period[size]
                for start in range(first, min(first + self.longest, end - size) + 1):
                    cost = min(cost, best[start] + 1 + math.log2(1 + (end - start) / size))
            best[end] = cost
        return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns; leftmost, not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


# Links, paths, references to variables and places to fill in: what stands beside a credential's name in manuals.
_REFERENCE = re.compile(
    r"""(?i:[a-z][a-z0-9+.-]*://)|[.~]{0,2}/(?:[\w.-]+/)*[\w.-]*$|(?:[A-Za-z]+(?:[-.'][A-Za-z]+)*/)+[A-Za-z]+(?:[-.'][A-Za-z]+)*$"""
    r"""|[$%]?[{(]|\$[A-Za-z_]|%[A-Za-z_]+%|<[^<>]*>?|(?:process|os)\.env|(?:\w+\.)*getenv|(?i:your|my|the|some|insert|enter|example)[-_ ]""")


def is_reference(value: str) -> bool:
    """Whether a value only names where a secret is or what to write. A link with a password in it is none."""
    return _REFERENCE.match(value) is not None and not re.match(r"[^/]*://[^/@:]*:[^/@]+@", value)


def _goes_round(text: str, begin: int, start: int, end: int) -> bool:
    """Whether ``start`` lies deep inside a block that comes again and again. The value one block before was no secret,
    and this one costs no more; without this, names that repeat would be costed as often as they come."""
    if start - begin < 64 or end - start < 64:
        return False
    near = text[start - 64:start + 64]
    return any(near[p:] == near[:-p] for p in range(2, 17))


def guess_spans(text: str, cost: GuessCost, least_bits: float, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, bits) of credential values that cost ``least_bits`` or more. Values that base spans
    cover to the end are left out; of others base spans may cover a part."""
    taken, found, k = sorted((s, e) for s, _, e in base), [], 0
    reach, at, run, end = -1, 0, 0, 0
    while m := CONTEXT.search(text, at):
        # A value may hold the next name, so the search goes on at its start unless it is taken.
        at = start = m.end()
        if start >= run:  # else the same signs go on: one end for all values in them
            begin, run = start, VALUE.match(text, start).end()
            end = start + len(text[start:run].rstrip(TRIM))
        reach = max(reach, start)
        while k < len(taken) and taken[k][0] <= reach:
            reach = max(reach, taken[k][1])
            k += 1
        # Prose after a name is no value: without an assignment it needs a digit or a sign inside.
        if reach >= end or end - start < 6 or _goes_round(text, begin, start, end):
            continue
        value = text[start:end]
        if not (re.search(r"[:=]", m[0]) or re.search(r"[^A-Za-z.,'-]", value)):
            continue
        bits = 0.0 if is_reference(value) else cost(value)
        if bits >= least_bits:
            found.append((start, 3, end, bits))
            at = end
    return found


def ranked_words(documents: DataFrame, most: int = 20_000, least_count: int = 20) -> tuple[str, ...]:
    """The fixed words, then the table's own by their counts over all documents: plain words of 3 to 20 letters that
    stand ``least_count`` times or more, ``most`` at most (about 200 KB, whatever the table's size)."""
    words = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")).alias("w")
    plain = F.regexp_extract("w", r"""^[("']*([a-z]{3,20})[.,;:!?)"']*$""", 1).alias("w")
    counts = documents.select(words).select(plain).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= least_count).orderBy(F.desc("n"), "w").limit(most).collect()
    return (*WORDS, *(r["w"] for r in top))


def listed(spans: Iterable[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


def scan_secrets(documents: DataFrame, least_bits: float = 40.0, words: Iterable[str] | None = None) -> DataFrame:
    """One row per row of ``documents``: counts, digest and spans (code points) of the secrets in its whole text.

    Words are ranked by ``ranked_words`` unless given. A null or empty text has none. Repeated rows give equal rows; other
    columns are ignored; no rows, no result.
    """
    words = ranked_words(documents) if words is None else tuple(words)

    def make():
        cost = GuessCost(words)

        def scan(text: str):
            base = base_spans(text)
            more = guess_spans(text, cost, least_bits, base)
            counts = [sum(s[1] == k for s in base) for k in range(3)]
            return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *more]), len(more),
                    max((s[3] for s in more), default=0.0))
        return scan

    return map_texts(documents, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                      "spans string, n_guess long, max_guess_bits double")


def redact(documents: DataFrame, least_bits: float = 40.0, words: Iterable[str] | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced; the columns stay, and so does a null text. ``n_chars`` follows.

    Repeated rows are replaced alike; an empty table stays empty. Words are ranked by ``ranked_words`` unless given.
    """
    import pyarrow as pa

    words, schema = ranked_words(documents) if words is None else tuple(words), documents.schema

    def run(batches):
        cost = GuessCost(words)

        def clean(text):
            if not text:
                return text
            base = base_spans(text)
            out, at = [], 0
            for start, end in sorted((s[0], s[2]) for s in [*base, *guess_spans(text, cost, least_bits, base)]):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [clean(t) for t in batch.column(i).to_pylist()]
            columns = list(batch.columns)
            columns[i] = pa.array(texts, batch.schema.field(i).type)
            j = batch.schema.get_field_index("n_chars")
            if j >= 0:
                before = batch.column(i).to_pylist()
                columns[j] = pa.array([n if a == b else len(b) for a, b, n in zip(before, texts, batch.column(j).to_pylist())],
                                      batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, schema)
