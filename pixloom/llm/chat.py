r"""Chat formatting: a template compiler that renders conversations as streams.

The template language is a small sandbox: text, ``{{ expression }}``,
``{% for x in expression %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% generation %}`` (its output is what a model is trained on) and
``{# comments #}``.  Expressions know names, string and integer literals,
``.field``, ``~`` (join), ``==``, ``!=``, ``and``, ``or``, ``not``, brackets and
``| filter``.  There are no calls, no attribute access on Python objects, and no
loops but over given data: ``.field`` reads keys of mappings only.

A template is parsed into a syntax tree, constants are folded (literal
expressions, filters of literals, branches with a constant test, neighbouring
text) and the tree becomes nested Python closures.  Rendering yields pieces, so
a conversation is consumed turn by turn and is never held whole.

Texts are escaped reversibly: in a text, a control string ``h...`` (first
character h) gets one backslash more after its ``h``; reading takes one away.
A control string is therefore never found in the output unless the template put
it there.

Defined cases: null text or role is empty; turns are ordered by (turn, role,
text), nulls first, repeated turns stay; a null conv_id is a conversation of its
own; an empty table has only the conversations added to it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches

#: Control strings of common chat formats.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)

_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] if m[0][1] != "\\" else m[0][0] + m[0][2:], text)


def escape_role(role: str) -> str:
    """Roles stand on one line: backslashes and line ends are spelt out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), unescape(role))


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}

DEFAULT_TEMPLATE = (
    "{# one block a turn #}{% for m in turns %}"
    "{{ '<|im_start|>' ~ (m.role | role) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    pass


# --- parsing -----------------------------------------------------------------
# Nodes are tuples: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)]) ("generation", body)
# Expressions:      ("lit", v) ("name", n) ("field", e, n) ("join", a, b) ("eq"|"ne"|"and"|"or", a, b) ("not", e) ("filter", e, n)

_PIECE = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.~|()]))")
_SPELT = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("op", "name") else None

    def take(self, *values: str) -> str | None:
        if self.peek() in values and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        made = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return made

    def either(self) -> tuple:
        made = self.both()
        while self.take("or"):
            made = ("or", made, self.both())
        return made

    def both(self) -> tuple:
        made = self.denied()
        while self.take("and"):
            made = ("and", made, self.denied())
        return made

    def denied(self) -> tuple:
        return ("not", self.denied()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        made = self.joined()
        if op := self.take("==", "!="):
            made = ("eq" if op == "==" else "ne", made, self.joined())
        return made

    def joined(self) -> tuple:
        made = self.filtered()
        while self.take("~"):
            made = ("join", made, self.filtered())
        return made

    def filtered(self) -> tuple:
        made = self.atom()
        while op := self.take(".", "|"):
            name = self.name()
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            made = ("field", made, name) if op == "." else ("filter", made, name)
        return made

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def atom(self) -> tuple:
        if self.take("("):
            made = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return made
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: _SPELT.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("lit", int(value))
        if kind == "name":
            return ("lit", value == "true") if value in ("true", "false") else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    pieces, at = [], 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m["out"] is not None:
            pieces.append(("out", m["out"]))
        elif m["tag"] is not None:
            pieces.append(("tag", m["tag"].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def body(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                nodes.append(("text", value))
                continue
            if kind == "out":
                nodes.append(("out", _Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return nodes, value
            if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                inner, _ = body("endfor")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                branches, test = [], _Expression(rest).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((test, inner))
                    if end == "endif":
                        break
                    test = _Expression(end.partition(" ")[2]).whole() if end.startswith("elif") else ("lit", True)
                nodes.append(("if", branches))
            elif word == "generation":
                nodes.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return body()[0]


# --- folding -----------------------------------------------------------------


def fold_expression(e: tuple) -> tuple:
    e = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in e)
    if e[0] in ("filter", "not") and e[1][0] == "lit" or e[0] in ("join", "eq", "ne", "and", "or") and e[1][0] == e[2][0] == "lit":
        return ("lit", closure(e)({}))
    return e


def fold(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        made: list[tuple] = [node]
        if node[0] == "out":
            e = fold_expression(node[1])
            made = [("text", _shown(e[1]))] if e[0] == "lit" else [("out", e)]
        elif node[0] == "for":
            made = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            made = [("generation", fold(node[1]))]
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "lit" and not test[1]:
                    continue
                branches.append((test, fold(inner)))
                if test[0] == "lit":
                    break
            made = ([] if not branches else branches[0][1] if branches[0][0][0] == "lit" else [("if", branches)])
        for x in made:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


# --- closures ----------------------------------------------------------------

Piece = tuple[str, bool]  # text, is it inside a generation block


def _shown(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be printed")


def closure(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "lit":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    a = closure(e[1])
    if kind == "field":
        return lambda scope, n=e[2]: x.get(n) if isinstance(x := a(scope), dict) else None
    if kind == "filter":
        f = FILTERS[e[2]]
        return lambda scope: f(_shown(a(scope)))
    if kind == "not":
        return lambda scope: not a(scope)
    b = closure(e[2])
    return {
        "join": lambda scope: _shown(a(scope)) + _shown(b(scope)),
        "eq": lambda scope: a(scope) == b(scope),
        "ne": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
    }[kind]


def generator(nodes: list[tuple], trained: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, s=node[1]: ((s, trained),))
        elif node[0] == "out":
            steps.append(lambda scope, f=closure(node[1]): ((_shown(f(scope)), trained),))
        elif node[0] == "generation":
            steps.append(generator(node[1], True))
        elif node[0] == "if":
            steps.append(_choice([(closure(t), generator(b, trained)) for t, b in node[1]]))
        else:
            steps.append(_loop(node[1], closure(node[2]), generator(node[3], trained)))

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _choice(branches):
    def run(scope: dict) -> Iterator[Piece]:
        for test, inner in branches:
            if test(scope):
                yield from inner(scope)
                return

    return run


def _loop(name: str, items, inner):
    def run(scope: dict) -> Iterator[Piece]:
        rest, n = iter(items(scope) or ()), 0
        here = next(rest, _END)
        while here is not _END:
            after = next(rest, _END)  # one turn ahead, to know the last
            yield from inner(scope | {name: here, "loop": {"index": n + 1, "first": n == 0, "last": after is _END}})
            here, n = after, n + 1

    return run


_END = object()


@functools.cache
def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    return generator(fold(parse(source)))


def render(source: str, turns: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the (start, end) code points of its generation blocks."""
    parts, spans, at, open_at = [], [], 0, None
    for text, trained in compile_template(source)({"turns": turns}):
        if trained and open_at is None:
            open_at = at
        elif not trained and open_at is not None:
            spans.append((open_at, at))
            open_at = None
        parts.append(text)
        at += len(text)
    if open_at is not None:
        spans.append((open_at, at))
    return "".join(parts), spans


# --- reading back --------------------------------------------------------------

_START, _STOP = "<|im_start|>", "<|im_end|>\n"


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn, from a stream of formatted output."""
    held, mask = "", []
    for text, trained in pieces:
        held += text
        if trained:
            mask.append(text)
        while (stop := held.find(_STOP)) >= 0:
            head, _, body = held[:stop].partition("\n")
            if not head.startswith(_START):
                raise ValueError("not a formatted turn")
            yield unescape_role(head[len(_START):]), unescape(body), unescape("".join(mask))
            held, mask = held[stop + len(_STOP):], []
    if held:
        raise ValueError("the last turn is not closed")


def digest(pieces: Iterable[Piece]) -> dict:
    """What a formatted conversation says, read back from its output piece by piece."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    seen = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0}

    def counted() -> Iterator[Piece]:
        for piece in pieces:
            seen["formatted_chars"] += len(piece[0])
            yield piece

    for role, text, trained in read_turns(counted()):
        seen["n_turns"] += 1
        seen["loss_chars"] += len(trained)
        turns.update(f"{role}\n{text}\n".encode())
        loss.update(trained.encode())
    return seen | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}


COLUMNS = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Conversations dealt by conv_id and sorted inside each partition: a group arrives as a stream."""
    turns = bounded_batches(conversations).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = (r for b in small_batches(batches) for r in b.to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans: each conversation rendered, with the code points under the loss mask."""
    compile_template(template)  # faults in a template show on the driver

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _streams(batches):
            text, spans = render(template, turns)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "formatted": text, "spans": [{"start": a, "stop": b} for a, b in spans]}], schema=out
            )

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    out = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span))])
    return ordered_turns(conversations).mapInArrow(
        lean(run), "conv_id long, formatted string, spans array<struct<start: long, stop: long>>"
    )


def conversation_digests(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One row for each conversation with what was read back from its formatted output.

    Hashes run in turn order, so one conversation is one stream; it passes
    through in pieces and a conversation of any length needs the memory of two
    turns.
    """
    compile_template(template)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv, turns in _streams(batches):
            made.append({"conv_id": conv} | digest(compile_template(template)({"turns": turns})))
            if len(made) == 1000:
                yield pa.RecordBatch.from_pylist(made, schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=out)

    out = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    return ordered_turns(conversations).mapInArrow(
        lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
