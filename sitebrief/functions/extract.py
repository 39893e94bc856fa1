"""Structured data in texts: e-mails, phones, addresses, social handles, technologies.

A text is scanned in one Arrow batch function: every pattern runs once over the whole text, and positions, keys and
contexts are taken from its matches, so time is linear in the length of a text. The patterns are written so that
searching does not go back over a run twice. Nothing leaves the row, so extraction needs no shuffle.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.functions import patterns as P
from sitebrief.functions.batches import each
from sitebrief.functions.urls import WS

_WORD = r"\p{L}\p{N}_"
_SPACE = WS[1:-1]


def portable(p: str) -> str:
    """Spell out \\w and \\s in their Unicode sense, as Java and RE2 both read it."""
    table = {
        r"[\w\s]": f"[{_WORD}{_SPACE}]", r"[\w\d]": f"[{_WORD}]", r"[\w]": f"[{_WORD}]",
        r"[-.\s]": f"[-.{_SPACE}]", r"\w": f"[{_WORD}]", r"\s": WS,
    }
    # One pass, longest spelling first, so that nothing put in is replaced again.
    return re.sub("|".join(re.escape(k) for k in table), lambda m: table[m.group()], p)


EMAIL = portable(P.EMAIL)
EMAIL_HIDDEN = "(?i)" + portable(P.EMAIL_HIDDEN)
PHONES = [portable(p) for p in P.PHONES]
ADDRESSES = [portable(p) for p in P.ADDRESSES]
SOCIAL = {k: [portable(p) for p in v] for k, v in P.SOCIAL_IN_TEXT.items()}

# The same two patterns without retries inside a run of address characters: a match
# starts where a run starts (or where the last match ended) and takes the run whole, because
# what must follow cannot stand inside a run.
_RUN = "[a-zA-Z0-9._%+-]"
_EMAIL_J = f"(?:\\G|(?<!{_RUN}))" + EMAIL.replace(_RUN + "+", _RUN + "++", 1)
_HIDDEN_J = f"(?i)(?:\\G|(?<!{_RUN}))" + EMAIL_HIDDEN[4:].replace(_RUN + "+", _RUN + "++", 1)

ENTITY = (
    "array<struct<type:string,value:string,normalized:string,confidence:double,context:string,"
    "extra:map<string,string>>>"
)


def email_ok(email: Column) -> Column:
    domain = F.substring_index(email, "@", -1)
    local = F.substring(email, F.lit(1), F.length(email) - F.length(domain) - 1)
    return (
        email.contains("@") & ~domain.isin(*P.PLACEHOLDER_DOMAINS) & ~domain.endswith(".png")
        & ~domain.endswith(".jpg") & (F.length(local) >= 1) & (F.length(domain) >= 3) & domain.contains(".")
    )


_ROW = pa.list_(pa.struct([
    ("type", pa.string()), ("value", pa.string()), ("normalized", pa.string()), ("confidence", pa.float64()),
    ("context", pa.string()), ("extra", pa.map_(pa.string(), pa.string()))]))


class Contexts:
    """Text around a match, widened to blanks, with dots where cut (``text.snippet`` on the driver's side)."""

    def __init__(self, text: str, width: int = 100):
        self.text, self.half = text, width // 2
        self.blanks: list[int] | None = None

    def __call__(self, start: int, end: int) -> str:
        if self.blanks is None:
            self.blanks = [m.start() for m in re.finditer(r"[ \n\t]", self.text)]
        text, n = self.text, len(self.text)
        left, right = max(start - self.half, 0), min(end + self.half, n)
        i = bisect.bisect_left(self.blanks, left)
        left = self.blanks[i - 1] + 1 if i else 0
        j = bisect.bisect_left(self.blanks, right)
        right = self.blanks[j] if j < len(self.blanks) else n
        return (("..." if left else "") + text[left:right] + ("..." if right < n else "")).strip()


Found = tuple[str, str, int, int]  # key, value, start, end


def _firsts(found: list) -> list:
    """The first match of each key."""
    seen: dict[str, tuple] = {}
    for m in found:
        seen.setdefault(m[0], m)
    return list(seen.values())


def _email_fits(email: str) -> bool:
    local, _, domain = email.rpartition("@")
    return bool(local) and domain not in P.PLACEHOLDER_DOMAINS and not domain.endswith((".png", ".jpg")) and (
        len(domain) >= 3 and "." in domain)


def scan_emails(text: str, around: Contexts) -> list[tuple]:
    """Plain addresses first, then written-out ones not seen plainly; bad domains are dropped last."""
    found = []
    if "@" in text:
        found += [(m.group().lower(), m.group(), *m.span(), 0.95) for m in _EMAIL_RUN.finditer(text)]
    if _HIDDEN_HINT.search(text):
        found += [("{}@{}.{}".format(*m.groups()).lower(), m.group(), *m.span(), 0.85) for m in _HIDDEN_RUN.finditer(text)]
    return [("email", value, key, c, around(s, e), []) for key, value, s, e, c in _firsts(found) if _email_fits(key)]


def scan_phones(text: str, around: Contexts) -> list[tuple]:
    # No number without ten digits: one cheap test spares the four patterns on most texts.
    if not _TEN_DIGITS.search(text):
        return []
    found = [("+1" + "".join(m.groups()[:3]), m.group(), *m.span(), m.group(4) if m.re.groups == 4 else None)
             for p in _PHONES for m in p.finditer(text)]
    return [("phone", value, key, 0.9, around(s, e), [("extension", ext)] if ext else [])
            for key, value, s, e, ext in _firsts(found)]


def address_matches(text: str) -> list[re.Match]:
    """All address matches, pattern by pattern, where the fixed part of a pattern occurs."""
    return [m for p, need in zip(_ADDRESS_RUNS, _ADDRESS_HINTS) if need.search(text) for m in p.finditer(text)]


def scan_addresses(text: str, around: Contexts) -> list[tuple]:
    found = [(" ".join(m.group().lower().split()), m.group().strip(), *m.span()) for m in address_matches(text)]
    return [("address", value, value, 0.8, around(s, e), []) for _, value, s, e in _firsts(found) if len(value) >= 15]


def scan_handles(text: str, around: Contexts) -> list[tuple]:
    low, found = text.lower(), []
    for platform, hints, pattern in _HANDLES:
        if any(h in low for h in hints):
            for m in pattern.finditer(text):
                handle = m.group(1).strip("/@")
                if handle.lower() not in P.SOCIAL_TEXT_SKIP:
                    found.append((f"{platform}:{handle.lower()}", m.group(), *m.span(), handle, platform))
    return [("social_handle", value, handle, 0.9, around(s, e), [("platform", platform)])
            for _, value, s, e, handle, platform in _firsts(found)]


def scan_tech(text: str, around: Contexts) -> list[tuple]:
    """One entry per technology named; its plain letters must occur before its pattern is counted."""
    low, out = text.lower(), []
    for category, name, words, pattern in _TECH_RUNS:
        if any(w in low for w in words):
            spans = [m.span() for m in pattern.finditer(text)]
            if spans:
                s, e = spans[0]
                out.append(("tech_stack", text[s:e], name, min(0.9, 0.7 + len(spans) * 0.05), around(s, e),
                            [("category", category), ("mentions", str(len(spans)))]))
    return out


def column(*scans):
    """A column function: the entities that the scans find in each text, in their order."""
    names = [f.name for f in _ROW.value_type]

    @F.arrow_udf(ENTITY)
    def run(texts: pa.Array) -> pa.Array:
        def found(text: str | None) -> list[dict]:
            around = Contexts(text or "")
            return [dict(zip(names, x)) for scan in scans for x in scan(text or "", around)]
        return each(texts, _ROW, found)

    return run


def snippets(pattern: str, width: int = 100):
    """A column function: start, end and context of every match of a pattern."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("context", pa.string())]))
    search = re.compile(pattern)

    @F.arrow_udf("array<struct<s: bigint, e: bigint, context: string>>")
    def run(texts: pa.Array) -> pa.Array:
        def found(text: str | None) -> list[dict]:
            around = Contexts(text or "", width)
            return [{"s": m.start(), "e": m.end(), "context": around(*m.span())} for m in search.finditer(text or "")]
        return each(texts, kind, found)

    return run


def with_emails(df: DataFrame, text: str = "text", out: str = "emails") -> DataFrame:
    return df.withColumn(out, column(scan_emails)(text))


def with_phones(df: DataFrame, text: str = "text", out: str = "phones") -> DataFrame:
    return df.withColumn(out, column(scan_phones)(text))


def with_addresses(df: DataFrame, text: str = "text", out: str = "addresses") -> DataFrame:
    return df.withColumn(out, column(scan_addresses)(text))


def with_social_handles(df: DataFrame, text: str = "text", out: str = "handles") -> DataFrame:
    return df.withColumn(out, column(scan_handles)(text))


def with_tech_stack(df: DataFrame, text: str = "text", out: str = "tech") -> DataFrame:
    return df.withColumn(out, column(scan_tech)(text))


# The address patterns, each linear in the text. They find what ADDRESSES find: words
# and spaces are taken whole up to a comma, the fixed part is looked for from the end of a
# stretch of words backwards (a greedy match prefers the last one), and a match starts only
# where such a stretch starts or the last match ended, because a start further in can do no more.
_WS_RUN = f"[{_WORD}{_SPACE}]"
_FRESH = f"(?:\\G|(?<!{_WS_RUN}))"
_POSTCODE = r"[A-Z]{1,2}\d{1,2}" + WS + r"*\d[A-Z]{2}"
_ADDRESSES_J = [
    r"(?i)(?:\G|(?<!\d))\d++" + ADDRESSES[0][len(r"(?i)\d+"):],
    _FRESH + _WS_RUN + "++," + WS + r"*+[A-Z]{2}" + WS + r"++\d{5}(?:-\d{4})?",
    f"(?i){_FRESH}(?:{_WS_RUN}++,{_WS_RUN}++,{WS}*+{_POSTCODE}|{_WS_RUN}++,{_WS_RUN}+{_POSTCODE}"
    f"|{_WS_RUN}{{2,}}+,{WS}*+{_POSTCODE}|{_WS_RUN}{{2,}}{_POSTCODE})",
]
_ADDRESS_NEEDS = [r"\d" + WS, r"[A-Z]{2}" + WS + r"+\d{5}", f"(?i){_POSTCODE}"]


def literals(pattern: str) -> list[str]:
    """Plain lower-case letters that each alternative of a pattern must contain at its start."""
    p = re.sub(r"\(\?!.*?\)|\(\?:[^)]*\)\?", "", pattern).replace(r"\b", "").replace("(?:", "").replace(")", "")
    heads = [re.match(r"(?:(?:\\[.+]|[A-Za-z0-9# ])(?!\?))+", alt).group() for alt in p.split("|")]
    return [h.replace("\\", "").lower() for h in heads]


TECH = [(cat, name, p) for cat, techs in P.TECHNOLOGIES.items() for name, p in techs.items()]


def _handle_hints(platform: str, pattern: str) -> list[str]:
    """The host that a pattern names, or the sign, must occur: a plain search decides first."""
    host = re.search(r"(\w+)\\.com/", pattern)
    if host:
        return [f"{host.group(1)}.com/"]
    return ["x.com/", "twitter.com/"] if platform == "twitter" and ".com/" in pattern else ["@"]


def _compiled(pattern: str) -> regex.Pattern:
    """The pattern with Java's code points written as Python's."""
    return regex.compile(re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


_EMAIL_RUN, _HIDDEN_RUN = _compiled(_EMAIL_J), _compiled(_HIDDEN_J)
# A written-out address has @ or "at" in one of these settings.
_HIDDEN_HINT = re.compile(r"(?i)@|[\[(]at|at[\])]|\sat\s")
_TEN_DIGITS = re.compile(r"\d{3}[^\d]{0,2}\d{3}[^\d]?\d{4}")
_PHONES = [re.compile(p) for p in P.PHONES]
_ADDRESS_RUNS = [_compiled(p) for p in _ADDRESSES_J]
_ADDRESS_HINTS = [_compiled(p) for p in _ADDRESS_NEEDS]
_HANDLES = [(platform, _handle_hints(platform, p), re.compile(p)) for platform, pats in P.SOCIAL_IN_TEXT.items() for p in pats]
_TECH_RUNS = [(cat, name, literals(p), re.compile("(?i)" + p)) for cat, name, p in TECH]


def entities(df: DataFrame, text: str = "text", tech_stack: bool = False) -> DataFrame:
    """All structured entities of each text: one scan, one batch function, one explode, no shuffle."""
    keep = [c for c in df.columns if c != text]
    scans = [scan_emails, scan_phones, scan_addresses, scan_handles, *([scan_tech] if tech_stack else [])]
    return explode_entities(df.withColumn("_all", column(*scans)(text)), "_all", keep)


def explode_entities(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    rows = explode_rows(df, column, keep).withColumnRenamed("_col", "_x")
    return rows.select(*keep, F.col("_pos").cast("bigint").alias("pos"), "_x.*")


def explode_rows(df: DataFrame, array: str | Column, keep: list[str]) -> DataFrame:
    """posexplode (columns _pos, _col) that evaluates the array once.

    For a plain explode the optimizer adds a filter on the array's size below it, which would
    run an expensive array expression again; the outer form gets no such filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", "_col"))
    return rows.filter(F.col("_pos").isNotNull())
