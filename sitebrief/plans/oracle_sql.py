"""Pieces of check SQL shared by several queries (DuckDB dialect)."""

from sitebrief.functions import patterns as P
from sitebrief.functions.urls import WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPLIT = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, {SPLIT}, {n})"


def scheme(u):
    return f"lower({part(u, 1)})"


def netloc(u):
    return part(u, 3)


def path(u):
    return f"regexp_replace({part(u, 4)}, ';[^/]*$', '')"


def query(u):
    return part(u, 5)


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x):
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def http(u):
    return f"(starts_with({u}, 'http://') OR starts_with({u}, 'https://'))"


def with_scheme(u):
    return f"CASE WHEN {http(u)} THEN {u} ELSE 'https://' || {u} END"


def content_hash(x):
    return f"substr(sha256({collapse('lower(' + strip(x) + ')')}), 1, 16)"


def platform(u):
    whens = " ".join(
        f"WHEN lower({netloc(u)}) IN ({', '.join(lit(h) for h in hosts)}) THEN '{p}'"
        for p, hosts in P.PLATFORM_HOSTS.items()
    )
    return f"CASE {whens} END"


LETTERS = (
    r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{370}-\x{373}\x{386}-\x{52f}\x{5d0}-\x{5ea}"
    r"\x{620}-\x{64a}\x{904}-\x{939}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
)


def ascii_words(x):
    """RE2 knows only ASCII word characters: turn every other letter into a plain one, length kept."""
    return f"regexp_replace({x}, '{LETTERS}', '_', 'g')"
