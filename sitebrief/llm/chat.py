"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python closure. Rendering
yields pieces ``(text, generated)`` one after the other; pieces inside ``{% generation %}`` carry True, which is the
loss mask. Messages come from an iterator, so a conversation of any length is rendered in bounded memory.

The language is sandboxed: names and fields are looked up in dictionaries only, there are no calls and no Python
attributes, and filters come from a fixed table.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitebrief.llm.common import schema_of

CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' ~ message.role | escape_name ~ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
START, END = "<|im_start|>", "<|im_end|>\n"


class TemplateError(ValueError):
    pass


# --- escaping: a control string cannot occur in an escaped text, and the step back is exact -----------------------

def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_name(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}

# --- parsing ------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[~+|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:at + 20]!r}")
        kind = ("number", "name", "string", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing: or, and, not, comparison, joining, filter, field."""

    def __init__(self, text: str):
        self.rest = _tokens(text)[::-1]

    def peek(self) -> str:
        return self.rest[-1][1] if self.rest and self.rest[-1][0] in ("name", "sign") else ""

    def take(self, *wanted: str) -> str:
        if self.peek() in wanted:
            return self.rest.pop()[1]
        return ""

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def whole(self):
        node = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[-1][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take("==", "!=", "in"):
            node = (sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.take("~", "+"):
            node = (sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.field()
        while self.take("|"):
            name = self.rest.pop()[1] if self.rest else ""
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node)
        return node

    def field(self):
        node = self.atom()
        while sign := self.take(".", "["):
            if sign == "[":
                node = ("get", node, self.either())
                self.need("]")
            elif self.rest and self.rest[-1][0] == "name":
                node = ("get", node, ("const", self.rest.pop()[1]))
            else:
                raise TemplateError("a field name is missing")
        return node

    def atom(self):
        if not self.rest:
            raise TemplateError("an expression is missing")
        kind, value = self.rest.pop()
        if kind == "number":
            return ("const", int(value))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if value == "(":
            node = self.either()
            self.need(")")
            return node
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str):
    """Syntax tree of a template: a list of statements."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at:m.start()]))
        if m[1] is not None:
            parts.append(("output", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()
    body, end = _block(parts, ())
    return body


def _block(parts: list, ends: tuple[str, ...]):
    body = []
    while parts:
        kind, value = parts.pop()
        if kind == "text":
            body.append(("emit", ("const", value)))
            continue
        if kind == "output":
            body.append(("emit", _Expression(value).whole()))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return body, value
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {value!r}")
            inner, _ = _block(parts, ("endfor",))
            body.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "if":
            body.append(_branches(parts, rest))
        elif word == "set":
            name, _, expression = rest.partition("=")
            body.append(("set", name.strip(), _Expression(expression).whole()))
        elif word == "generation":
            inner, _ = _block(parts, ("endgeneration",))
            body.append(("generation", inner))
        else:
            raise TemplateError(f"unknown tag {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return body, ""


def _branches(parts: list, condition: str):
    test = _Expression(condition).whole()
    then, end = _block(parts, ("elif", "else", "endif"))
    word, _, rest = end.partition(" ")
    if word == "elif":
        return ("if", test, then, [_branches(parts, rest)])
    return ("if", test, then, _block(parts, ("endif",))[0] if word == "else" else [])


# --- folding ------------------------------------------------------------------------------------------------------

def fold(node):
    """Evaluate what holds constants only, drop dead branches, and join neighbouring constant output."""
    if isinstance(node, list):
        out = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if y[0] == "emit" and y[1] == ("const", ""):
                    continue
                if y[0] == "emit" and y[1][0] == "const" and out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                    out[-1] = ("emit", ("const", _text(out[-1][1][1]) + _text(y[1][1])))
                else:
                    out.append(y)
        return out
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind in ("for", "set"):
        return (kind, node[1], *map(fold, node[2:]))
    if kind == "if":
        test, then, other = map(fold, node[1:])
        if test[0] == "const":
            return then if test[1] else other
        return ("if", test, then, other)
    folded = (kind, *(x if isinstance(x, str) else fold(x) for x in node[1:]))
    if kind not in ("emit", "generation") and all(x[0] == "const" for x in folded[1:] if not isinstance(x, str)):
        return ("const", _value(folded)({}))
    return folded


# --- closures -----------------------------------------------------------------------------------------------------

def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _lookup(owner, key):
    return owner.get(key) if isinstance(owner, dict) else None


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "filter":
        inner, f = _value(node[2]), FILTERS[node[1]]
        return lambda scope: f(_text(inner(scope)))
    a = _value(node[1])
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(node[2])
    return {
        "or": lambda scope: a(scope) or b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "in": lambda scope: _text(a(scope)) in _text(b(scope)),
        "~": lambda scope: _text(a(scope)) + _text(b(scope)),
        "+": lambda scope: _text(a(scope)) + _text(b(scope)),
        "get": lambda scope: _lookup(a(scope), b(scope)),
    }[kind]


def _statement(node):
    kind = node[0]
    if kind == "emit":
        value = _value(node[1])

        def emit(scope, generated):
            yield _text(value(scope)), generated
        return emit
    if kind == "set":
        name, value = node[1], _value(node[2])

        def put(scope, generated):
            scope[name] = value(scope)
            return iter(())
        return put
    if kind == "generation":
        inner = _body(node[1])
        return lambda scope, generated: inner(scope, True)
    if kind == "if":
        test, then, other = _value(node[1]), _body(node[2]), _body(node[3])
        return lambda scope, generated: (then if test(scope) else other)(scope, generated)
    name, items, inner = node[1], _value(node[2]), _body(node[3])

    def loop(scope, generated):
        values, index, end = iter(items(scope) or ()), 0, object()
        value = next(values, end)
        while value is not end:
            after = next(values, end)  # one message ahead, for loop.last
            own = {**scope, name: value, "loop": {"index": index + 1, "first": index == 0, "last": after is end}}
            yield from inner(own, generated)
            value, index = after, index + 1
    return loop


def _body(nodes: list):
    steps = [_statement(n) for n in nodes]

    def run(scope, generated):
        for step in steps:
            yield from step(scope, generated)
    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """``compile_template(source)(messages)`` yields the output's pieces and whether each is to be learnt."""
    run = _body(fold(parse(source)))
    return lambda messages, **names: run({"messages": messages, **names}, False)


# --- reading back -------------------------------------------------------------------------------------------------

class ChatReader:
    """Reads pieces of CHATML output back into turns; holds one turn at a time."""

    def __init__(self):
        self.buffer: list[tuple[str, bool]] = []
        self.open = ""

    def feed(self, text: str, generated: bool) -> Iterator[tuple[str, str, str]]:
        """Turns that this piece closes: role, text, and what of the text is to be learnt."""
        while text:
            # An end mark may be split over pieces: look for it in the tail of what came before, too.
            joined = self.open + text
            cut = joined.find(END)
            if cut < 0:
                self.buffer.append((text, generated))
                self.open = joined[-(len(END) - 1):]
                return
            take = cut + len(END) - len(self.open)
            self.buffer.append((text[:take], generated))
            text, self.open = text[take:], ""
            yield self._turn()

    def _turn(self) -> tuple[str, str, str]:
        pieces, self.buffer = self.buffer, []
        whole = "".join(t for t, _ in pieces)
        if not whole.startswith(START):
            raise ValueError("a turn without a start mark")
        role, _, body = whole[len(START):-len(END)].partition("\n")
        learnt = "".join(t for t, generated in pieces if generated)
        return unescape(role), unescape(body), unescape(learnt)


# --- Spark --------------------------------------------------------------------------------------------------------

def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _groups(batches: Iterator[pa.RecordBatch]):
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return itertools.groupby(rows, key=lambda r: r[0])


def _emit(rows: Iterator[tuple], types: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), types)], schema=types)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """One row per conversation: its formatted text and the spans of the loss mask (code points, end exclusive).

    Rows go by turn; equal turns go by role, then text; a null turn comes first. A null role or text is empty; rows
    with a null conv_id form one conversation. Other columns are ignored; an empty table gives no rows.
    """
    out = schema_of("conv_id long, formatted string, learnt array<struct<start: long, end: long>>")
    types = to_arrow_schema(out)

    def run(batches):
        render = compile_template(template)

        def rows():
            for conv, group in _groups(batches):
                pieces, spans, at = [], [], 0
                for text, generated in render({"role": r[2], "text": r[3]} for r in group):
                    pieces.append(text)
                    if generated and text:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                yield conv, "".join(pieces), spans
        yield from _emit(rows(), types, 100)

    return _in_order(conversations).mapInArrow(run, out)


def format_digests(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """Formats each conversation, reads the output back, and returns counts and digests of what was read.

    The pieces are rendered and read as a stream over the sorted rows, so that a conversation of any length needs the
    memory of one turn. Cases as in format_conversations.
    """
    out = schema_of("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                    "formatted_chars long")
    types = to_arrow_schema(out)

    def run(batches):
        render = compile_template(template)

        def rows():
            for conv, group in _groups(batches):
                turns, loss, reader = hashlib.sha256(), hashlib.sha256(), ChatReader()
                n_turns = loss_chars = chars = 0
                for text, generated in render({"role": r[2], "text": r[3]} for r in group):
                    chars += len(text)
                    for role, body, learnt in reader.feed(text, generated):
                        n_turns += 1
                        turns.update(f"{role}\n{body}\n".encode())
                        loss.update(learnt.encode())
                        loss_chars += len(learnt)
                yield conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
        yield from _emit(rows(), types)

    return _in_order(conversations).mapInArrow(run, out)
