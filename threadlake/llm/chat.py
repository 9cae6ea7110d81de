"""Chat formatting by a compiled template.

A small template language is parsed into a syntax tree, constants are folded, and the tree is
turned into Python closures. It knows text, ``{{ expression }}``, ``{% for x in name %}``,
``{% if %}`` / ``{% elif %}`` / ``{% else %}``, and ``{% generation %}``, which marks what a
model is trained to say. Expressions are names, attributes of mappings, string and whole
number literals, ``loop.first``, ``loop.index``, comparisons, ``+``, ``and``, ``or``, ``not``
and filters from a fixed list. Nothing else can be reached from a template: attributes are
keys of mappings, there are no calls, and a loop runs over what it is given once.

Turns of a conversation are rendered as they arrive in their order, so no conversation is held
as a whole. Control strings in texts are escaped: a backslash becomes two, ``<|`` becomes
``<\\|``; no text can then contain a marker, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TEMPLATE = (
    "{% for turn in turns %}"
    "{{ '<|turn|>' + (turn.role | escape_line) + '\\n' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '<|end|>' + '\\n' }}"
    "{% endfor %}"
)
OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree -------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    of: Any
    key: str


@dataclass(frozen=True)
class Apply:
    """A filter, operator or ``not`` over its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class For:
    var: str
    over: Any
    body: Any


@dataclass(frozen=True)
class Generation:
    body: Any


_PIECES = re.compile(r"(\{%.*?%\}|\{\{.*?\}\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|().]))""", re.S)


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {kind or 'more'} in {self.tokens}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def chain(self, below, *ops: str):
        left = below()
        while self.peek(*ops):
            left = Apply(self.take(), (left, below()))
        return left

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self.chain(self.sum, "==", "!=")

    def sum(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        value = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def atom(self):
        if self.peek("("):
            self.take()
            value = self.either()
            if not self.peek(")"):
                raise TemplateError("missing )")
            self.take()
        else:
            kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
            if kind == "str":
                value = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1:-1], flags=re.S))
            elif kind == "int":
                value = Const(int(self.take()))
            else:
                value = Name(self.take("name"))
        while self.peek("."):
            self.take()
            value = Attr(value, self.take("name"))
        return value


def parse(source: str):
    """The syntax tree of a template."""
    pieces = [p for p in _PIECES.split(source) if p]
    at = 0

    def block(*ends: str):
        nonlocal at
        parts = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                parts.append(Emit(_Expression(piece[2:-2]).whole()))
            elif not piece.startswith("{%"):
                parts.append(Emit(Const(piece)))
            else:
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return Block(tuple(parts)), word, rest
                if word == "if":
                    parts.append(branch(rest))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"cannot read for {rest!r}")
                    parts.append(For(m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "generation":
                    parts.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return Block(tuple(parts)), "", ""

    def branch(test: str):
        then, word, rest = block("elif", "else", "endif")
        if word == "elif":
            other = branch(rest)
        else:
            other = block("endif")[0] if word == "else" else Block(())
        return If(_Expression(test).whole(), then, other)

    return block()[0]


def _combine(op: str, args: list) -> Any:
    if op.startswith("|"):
        return FILTERS[op[1:]](_text(args[0]))
    if op == "not":
        return not args[0]
    a, b = args
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return {"==": a == b, "!=": a != b, "and": a and b, "or": a or b}[op]


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node):
    """The tree with constant expressions computed, constant texts joined and decided
    branches resolved."""
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        return Const(_combine(node.op, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Apply(node.op, args)
    if isinstance(node, Attr):
        return Attr(fold(node.of), node.key)
    if isinstance(node, Emit):
        value = fold(node.value)
        return Emit(Const(_text(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.var, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Block):
        parts: list = []
        for p in map(fold, node.parts):
            for x in p.parts if isinstance(p, Block) else (p,):
                if isinstance(x, Emit) and isinstance(x.value, Const) and parts and isinstance(parts[-1], Emit) and isinstance(parts[-1].value, Const):
                    parts[-1] = Emit(Const(parts[-1].value.value + x.value.value))
                elif x != Emit(Const("")):
                    parts.append(x)
        return Block(tuple(parts))
    return node


# --- closures ----------------------------------------------------------------------------

# A rendered piece: its text and whether it lies under a generation marker. None ends a round
# of an outermost loop, so pieces can be handed on before the next turn is read.
Piece = tuple[str, bool] | None


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env, key=node.name):
            if key not in env:
                raise TemplateError(f"no name {key!r}")
            return env[key]

        return name
    if isinstance(node, Attr):
        of = _value(node.of)

        def attribute(env, key=node.key):
            owner = of(env)
            if not isinstance(owner, dict) or key not in owner:
                raise TemplateError(f"no key {key!r}")
            return owner[key]

        return attribute
    args = [_value(a) for a in node.args]
    if node.op in ("and", "or"):
        left, right = args
        return (lambda env: left(env) and right(env)) if node.op == "and" else (lambda env: left(env) or right(env))
    return lambda env, op=node.op: _combine(op, [a(env) for a in args])


def _render(node, marked: bool, depth: int) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Emit):
        value = _value(node.value)

        def emit(env):
            yield _text(value(env)), marked

        return emit
    if isinstance(node, Generation):
        if marked:
            raise TemplateError("generation inside generation")
        return _render(node.body, True, depth)
    if isinstance(node, Block):
        parts = [_render(p, marked, depth) for p in node.parts]

        def block(env):
            for p in parts:
                yield from p(env)

        return block
    if isinstance(node, If):
        test, then, other = _value(node.test), _render(node.then, marked, depth), _render(node.other, marked, depth)
        return lambda env: then(env) if test(env) else other(env)
    over, body = _value(node.over), _render(node.body, marked, depth + 1)

    def loop(env, var=node.var):
        for i, item in enumerate(over(env)):
            yield from body({**env, var: item, "loop": {"first": i == 0, "index": i + 1}})
            if depth == 0:
                yield None

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields its pieces."""
    run = _render(fold(parse(source)), False, 0)
    return lambda **env: run(env)


# --- conversations -----------------------------------------------------------------------


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted conversations (conv_id, turn, role, text; other columns are ignored), piece by
    piece: conv_id, piece (from 0), formatted, spans (array of start, end: code points of the
    piece under the loss mask). The pieces of a conversation in order are its whole text.

    Turns are taken in the order of turn (null first), role and text. Null roles and texts are
    empty, a null conv_id is a conversation of its own, repeated rows are turns each.
    Conversations are spread by id and streamed: a very long one takes one task, but only a
    batch of its turns is in memory.
    """
    compile_template(template)  # errors show before any task runs
    schema = pa.schema([
        ("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def pack(pieces: list[Piece]) -> tuple[str, list[dict]]:
        out, spans, at = [], [], 0
        for text, marked in pieces:
            if marked and text:
                spans.append({"start": at, "end": at + len(text)})
            out.append(text)
            at += len(text)
        return "".join(out), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows: list[tuple] = []
        held = 0

        def turns() -> Iterator[tuple]:
            for b in batches:
                for c, role, text in zip(*(x.to_pylist() for x in b.columns)):
                    yield c, {"role": role, "text": text}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for conv, own in groupby(turns(), key=lambda x: x[0]):
            pieces: list[Piece] = []
            n = 0
            for p in _with_end(render(turns=(x[1] for x in own))):
                if p is not None:
                    pieces.append(p)
                    continue
                if pieces:
                    rows.append((conv, n, *pack(pieces)))
                    held += len(rows[-1][2])
                    n, pieces = n + 1, []
                if held > 4_000_000:
                    yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()

    ordered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, piece long, formatted string, spans array<struct<start:int,end:int>>")


def _with_end(pieces: Iterable[Piece]) -> Iterator[Piece]:
    yield from pieces
    yield None


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns in formatted text of TEMPLATE, unescaped."""
    out = []
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn marker")
        out.append((unescape(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return out


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests per conversation of ``format_turns`` with TEMPLATE, read from its output:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(x.to_pylist() for x in b.columns))

        out = []
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, spans in own:
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    loss_chars += len(said)
                chars += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "spans")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ESCAPED = "\\### Assistant: </turn> ok"


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", ESCAPED), (-7, 1, "assistant", ESCAPED)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(given.unionByName(extra)))


_ESC = "replace(replace({c}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ESCAPED}' UNION ALL SELECT -7, 1, 'assistant', '{ESCAPED}')
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
  CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({_ESC.format(c="r")}, chr(10), chr(92) || 'n')) + length({_ESC.format(c="t")})) AS BIGINT) formatted_chars
FROM c GROUP BY conv_id
"""
