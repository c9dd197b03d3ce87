"""Chat formatting by a small sandboxed template language.

A template is parsed to a syntax tree, constants are folded, and each node becomes a Python closure that yields
(text, under generation). Values are strings, numbers, booleans, none, mappings and sequences; only their keys
can be read, nothing can be called but the filters listed here, so a template reaches nothing else.

    {{ expression }}   {% set x = expression %}   {% generation %} ... {% endgeneration %}
    {% for x in expression %} ... {% endfor %}   (loop.index, loop.index0, loop.first)
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import shipped

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without the opening of any control string: a backslash more goes between its two characters."""
    return CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """The same on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "escape_line": escape_line,
    "trim": lambda v: v.strip(),
    "upper": lambda v: v.upper(),
    "lower": lambda v: v.lower(),
    "length": len,
    "default": lambda v, d="": d if v is None else v,
}

#: Marks turns; assistant texts, and nothing else, are under generation.
CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
WORD = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+~.|()\[\],=]))""")
NAMED = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
COMPARED: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}


class TemplateError(ValueError):
    """A template that can't be read, or a value that can't be used as it says."""


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _key(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError(f"no key can be read of {type(value).__name__}")


class _Expression:
    """Recursive descent over one expression; nodes are tuples whose first item is their kind."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            if not (m := WORD.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            at = m.end()
            kind = ("string", "number", "name", "sign")[next(i for i, g in enumerate(m.groups()) if g is not None)]
            self.words.append((kind, m.group().strip()))
        self.at = 0

    def next_is(self, *texts: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] != "string" and self.words[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if texts and not self.next_is(*texts) or self.at >= len(self.words):
            raise TemplateError(f"expected {' or '.join(texts) or 'a value'}")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.next_is("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.next_is("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.next_is("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        if self.next_is(*COMPARED):
            node = ("compare", self.take(), node, self.joined())
        elif self.next_is("not"):
            self.take()
            self.take("in")
            node = ("not", ("compare", "in", node, self.joined()))
        return node

    def joined(self) -> tuple:
        node = self.summed()
        while self.next_is("~"):
            node = (self.take(), node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while self.next_is("+", "-"):
            node = (self.take(), node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.value()
        while self.next_is("|"):
            self.take()
            name, given = self.take(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.next_is("("):
                self.take()
                while not self.next_is(")"):
                    given.append(self.either())
                    if not self.next_is(")"):
                        self.take(",")
                self.take(")")
            node = ("filter", name, node, *given)
        return node

    def value(self) -> tuple:
        if self.next_is("("):
            self.take()
            node = self.either()
            self.take(")")
        else:
            kind, text = self.words[self.at] if self.at < len(self.words) else ("", "")
            self.take()
            if kind == "string":
                node = ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "number":
                node = ("constant", float(text) if "." in text else int(text))
            elif kind == "name" and text in NAMED:
                node = ("constant", NAMED[text])
            elif kind == "name":
                node = ("name", text)
            else:
                raise TemplateError(f"unexpected {text!r}")
        while self.next_is(".", "["):
            if self.take() == ".":
                node = ("key", node, ("constant", self.take()))
            else:
                node = ("key", node, self.either())
                self.take("]")
        return node


def _fold(node: tuple) -> tuple:
    """The expression with every part that depends on no name worked out."""
    if node[0] in ("constant", "name"):
        return node
    node = tuple(_fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "constant" for x in node if isinstance(x, tuple)):
        try:
            return ("constant", _evaluator(node)({}))
        except TypeError as e:
            raise TemplateError(str(e)) from e
    return node


def _evaluator(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    parts = [_evaluator(x) for x in node[1:] if isinstance(x, tuple)]
    a, b = parts[0], parts[1] if len(parts) > 1 else None
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "not":
        return lambda scope: not a(scope)
    if kind == "compare":
        return lambda scope, f=COMPARED[node[1]]: f(a(scope), b(scope))
    if kind == "~":
        return lambda scope: _shown(a(scope)) + _shown(b(scope))
    if kind == "+":
        return lambda scope: a(scope) + b(scope)
    if kind == "-":
        return lambda scope: a(scope) - b(scope)
    if kind == "key":
        return lambda scope: _key(a(scope), b(scope))
    return lambda scope, f=FILTERS[node[1]]: f(a(scope), *(p(scope) for p in parts[1:]))


def parse(source: str) -> list[tuple]:
    """The syntax tree: lists of ("text", s), ("show", e), ("set", x, e), ("for", x, e, body), ("if", [(e, body)], other), ("generation", body)."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in TAG.finditer(source):
        pieces += [("text", source[at : m.start()])] if m.start() > at else []
        pieces.append(("show", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    pieces += [("text", source[at:])] if at < len(source) else []
    position = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal position
        body: list[tuple] = []
        while position < len(pieces):
            kind, text = pieces[position]
            position += 1
            word, _, rest = text.partition(" ")
            if kind == "text":
                body.append(("text", text))
            elif kind == "show":
                body.append(("show", _fold(_Expression(text).whole())))
            elif word in ends:
                return body, text
            elif word == "generation":
                body.append(("generation", block(("endgeneration",))[0]))
            elif word == "set" and (m := re.fullmatch(r"(\w+)\s*=(.*)", rest, re.S)):
                body.append(("set", m[1], _fold(_Expression(m[2]).whole())))
            elif word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s(.*)", rest, re.S)):
                body.append(("for", m[1], _fold(_Expression(m[2]).whole()), block(("endfor",))[0]))
            elif word == "if":
                cases, other, test = [], [], rest
                while test is not None:
                    inner, end = block(("elif", "else", "endif"))
                    cases.append((_fold(_Expression(test).whole()), inner))
                    test = end[4:] if end.startswith("elif") else None
                    if end == "else":
                        other, _ = block(("endif",))
                body.append(("if", cases, other))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return fold_body(block(())[0])


def fold_body(body: list[tuple]) -> list[tuple]:
    """Constant expressions as text, texts beside each other as one, and only the branches that can be reached."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "show" and node[1][0] == "constant":
            node = ("text", _shown(node[1][1]))
        elif node[0] == "for":
            node = (*node[:3], fold_body(node[3]))
        elif node[0] == "generation":
            node = ("generation", fold_body(node[1]))
        elif node[0] == "if":
            cases, other = [], fold_body(node[2])
            for test, inner in node[1]:
                if test[0] == "constant" and test[1]:
                    other = fold_body(inner)
                    break
                if test[0] != "constant":
                    cases.append((test, fold_body(inner)))
            if not cases:
                for x in other:
                    add(x)
                continue
            node = ("if", cases, other)
        add(node)
    return out


def _closure(body: list[tuple], under: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [_step(node, under) for node in body]

    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return steps[0] if len(steps) == 1 else run


def _step(node: tuple, under: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        both = ((node[1], under),)
        return lambda scope: both
    if kind == "show":
        value = _evaluator(node[1])
        return lambda scope: ((_shown(value(scope)), under),)
    if kind == "generation":
        return _closure(node[1], True)
    if kind == "set":
        value = _evaluator(node[2])

        def assign(scope: dict) -> Iterable:
            scope[node[1]] = value(scope)
            return ()

        return assign
    if kind == "if":
        cases, other = [(_evaluator(t), _closure(b, under)) for t, b in node[1]], _closure(node[2], under)

        def choose(scope: dict) -> Iterable:
            for test, inner in cases:
                if test(scope):
                    return inner(scope)
            return other(scope)

        return choose
    values, inner = _evaluator(node[2]), _closure(node[3], under)

    def loop(scope: dict) -> Iterator[tuple[str, bool]]:
        own = dict(scope)
        for i, own[node[1]] in enumerate(values(scope) or ()):
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0}
            yield from inner(own)

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """From names to the pieces of the output in order, each with whether it is under generation."""
    return _closure(parse(source), False)


def format_conversations(turns: DataFrame, template: str = CHATML, part_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, part, text, spans): each conversation's output, and where in it generation is marked.

    Columns conv_id, turn, role and text are used, others ignored. Rows go by turn, then role, then text, nulls
    first; a null role or text is empty; repeated rows are turns of their own; rows with a null conv_id make one
    conversation; an empty table gives none. Turns stream through the template in that order, so a conversation
    of any length takes the memory of about ``part_chars`` characters or its longest turn: its output is the
    texts of its parts in order, of which there is one unless it is longer than that. ``spans`` are starts and
    ends in code points of the part.
    """
    schema = "conv_id long, part long, text string, spans array<struct<start:long,end:long>>"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows = ((c, {"turn": t, "role": r, "text": x}) for b in batches for c, t, r, x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True))
        ahead = next(rows, None)
        out: list[tuple] = []
        held = 0
        while ahead:
            conv = ahead[0]
            begun = 0  # turns handed to the template

            def messages() -> Iterator[dict]:
                nonlocal ahead, begun
                while ahead and ahead[0] == conv:
                    begun += 1
                    now, ahead = ahead[1], next(rows, None)
                    yield now

            part, texts, spans, chars, seen = 0, [], [], 0, 1
            for text, under in render({"messages": messages()}):
                if begun > seen and chars >= part_chars:
                    out.append((conv, part, "".join(texts), spans))
                    held += chars
                    part, texts, spans, chars = part + 1, [], [], 0
                seen = begun
                if under:
                    spans.append({"start": chars, "end": chars + len(text)})
                texts.append(text)
                chars += len(text)
                if held >= 4 * part_chars:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "part", "text", "spans"])
                    out, held = [], 0
            out.append((conv, part, "".join(texts), spans))
            held += chars
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "part", "text", "spans"])

    used = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return shipped(used).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """From the output alone, per conversation: turns and their digest, the text under generation and its digest, length.

    Takes the rows of ``format_conversations`` with the turn-marking template, a conversation's parts together
    and in order, as that leaves them.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done: list[tuple] = []
            for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "spans")), strict=True):
                if part == 0:
                    done += [_closed(now)] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"the output of conversation {conv} can't be read at {at}")
                    at = m.end()
                    now[1] += 1
                    now[2].update(f"{unescape_line(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"the output of conversation {conv} can't be read at {at}")
                for span in spans:
                    own = unescape(text[span["start"] : span["end"]])
                    now[3] += len(own)
                    now[4].update(own.encode())
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(_closed(now), strict=True), kinds, strict=True)], names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(now: list) -> tuple:
    return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
