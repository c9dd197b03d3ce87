"""Licence notices and identifiers in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts

# The phrases that are always looked for, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that the method adds, as the words of the phrase and its label.
NOTICES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
    "may not be reproduced": "reserved",
    "do not distribute": "proprietary",
}
# How freely a text under each label may be used again.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "cc": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN_FREEDOM, NO_NOTICE = 0.4, 0.5
#: Identifier tags, each with whatever stands after it on its line.
TAGS = ("spdx-license-identifier:", "license-expression:")

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PART = re.compile(r"[()]|[^\s()]+")
#: How tightly each operator binds.
BINDS = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """A licence expression that can't be read."""


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the operands and operators of an and/or/with expression in the order of evaluation."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last part was one
    for part in _PART.findall(expression.lower()):
        if part in BINDS:
            if not operand:
                raise ExpressionError(f"{part} lacks what it joins")
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[part]:
                out.append(waiting.pop())
            waiting.append(part)
            operand = False
        elif part == "(":
            if operand:
                raise ExpressionError("an operator is missing before (")
            waiting.append(part)
        elif part == ")":
            if not operand:
                raise ExpressionError("nothing before )")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ExpressionError(") closes nothing")
            waiting.pop()
        else:
            if operand:
                raise ExpressionError(f"an operator is missing before {part}")
            out.append(part)
            operand = True
    if not operand or "(" in waiting:
        raise ExpressionError("it ends early")
    return out + waiting[::-1]


def label_of(identifier: str) -> str:
    """The family of an identifier, or itself."""
    plain = identifier.lower()
    if plain.startswith(("cc0", "cc-by")):
        return "cc0" if plain.startswith("cc0") else "cc-by" if re.fullmatch(r"cc-by(-\d.*)?", plain) else "cc"
    return next((f for f in ("agpl", "lgpl", "gpl", "mit", "isc", "bsd", "apache", "mpl", "epl", "zlib", "unlicense") if re.match(rf"{f}([-.+]|\d|$)", plain)), plain)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and freedom: the freer side of an or, the stricter of an and; an exception leaves its licence's, a little freer."""
    stack: list[tuple[set[str], float, str]] = []
    for part in postfix(expression):
        if part not in BINDS:
            label = label_of(part)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM), part))
            continue
        b, a = stack.pop(), stack.pop()
        if part == "with":
            stack.append((a[0], min(1.0, a[1] + 0.1), a[2]))
        else:
            stack.append((a[0] | b[0], (max if part == "or" else min)(a[1], b[1]), part))
    return stack[0][0], stack[0][1]


@lru_cache(1)
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE_PHRASES).items():
        phrases.add_word(f" {phrase} ", (label, len(phrase.split()), phrase in BASE_PHRASES))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def find_notices(data: bytes) -> tuple[int, list[tuple[str, int, bool]]]:
    """How many words, and (label, first word, of the base list) of all places where a phrase's words stand together."""
    words = f" {b' '.join(data.translate(_KEPT).split()).decode()} "
    found, at, spaces = [], 0, 0
    for end, (label, n, base) in _automata()[0].iter(words):
        spaces += words.count(" ", at, end + 1)
        at = end + 1
        found.append((label, spaces - 1 - n, base))
    return (words.count(" ") - 1 if len(words) > 2 else 0), found


def find_expressions(data: bytes) -> Iterator[str]:
    """What stands after each identifier tag on its line, without the close of a comment."""
    low = data.translate(_LOWER)
    if not any(tag.encode() in low for tag in TAGS):
        return
    text = data.decode()
    for end, _ in _automata()[1].iter(low.decode()):
        line_end = text.find("\n", end)
        yield re.split(r"\*/|-->|[\"';,]", text[end + 1 : line_end if line_end >= 0 else len(text)])[0].strip()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, expressions, labels, score), a row for each row of ``docs``.

    ``hits``: label, first word and whether of the base list, of every place of a phrase, in the order in which
    the places end. ``expressions``: those after identifier tags, as they stand; one that can't be read gives no
    label. ``labels``: of hits and expressions, distinct and sorted. ``score``: how freely the text may be used
    again, the strictest of all found, from 0 to 1; without any notice the middle. A null text is empty: no
    word, no hit. A null id stays null, repeated rows are scanned each, other columns are ignored, an empty
    table gives an empty one.
    """
    hit = pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
    kinds = [pa.int64(), pa.int64(), pa.list_(hit), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]

    def make():
        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                data = text.encode()
                n, hits = find_notices(data)
                labels = {x[0] for x in hits}
                freedom = [FREEDOM[x] for x in labels]
                expressions = list(find_expressions(data))
                for e in expressions:
                    try:
                        own, value = evaluate(e)
                    except ExpressionError:
                        continue
                    labels |= own
                    freedom.append(value)
                rows.append((doc_id, n, [{"label": a, "word": w, "base": b} for a, w, b in hits], expressions, sorted(labels), min(freedom, default=NO_NOTICE)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "hits", "expressions", "labels", "score"])

        return work

    return map_texts(docs, make, "doc_id long, n_words long, hits array<struct<label:string,word:long,base:boolean>>, expressions array<string>, labels array<string>, score double", id_col, text_col)


def license_report(scans: DataFrame) -> DataFrame:
    """Counts and places of the base list, and all labels as text, a row for each of ``scan_licenses``.

    Without a place of the base list both words are null and the labels empty; a null id stays null.
    """
    base = F.filter("hits", lambda h: h["base"])
    places = F.transform(base, lambda h: h["word"])
    return scans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda h: h["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
