"""Byte-level ids and pre-tokens of texts under a tokenizer file.

The pre-token pattern of byte-level vocabularies never joins a visible character to the blank after it, so a long
text may be cut before any run of blanks. Vocabularies of other kinds go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The pattern that byte-level vocabularies were made with, and how a byte looks in them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters of blocks in which all versions of Unicode agree on what is a letter or a number; libraries differ in theirs.
UNSTEADY = re.compile("[^\x00-\u0557\u0e00-\u0e7f\u1e00-\u206f\u20a0-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]")
OTHER_SPACE = re.compile(r"[^\S \n]")
SAFE_CUT = re.compile(r"(?<=\S)[ \n]")
SPAN = 1 << 20


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """The text in parts of about ``span`` characters, each cut before a run of blanks."""
    start = 0
    while len(text) - start > span and (cut := SAFE_CUT.search(text, start + span)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes to id, where ids are dealt in the order of the merges, as a merge by rank needs them; else None."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    byte_of = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != len(byte_of) + i for i, (a, b) in enumerate(merges)) or not set("".join(vocab)) <= set(byte_of):
        return None
    return {bytes(byte_of[c] for c in word): i for word, i in vocab.items()}


def _merger(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Text to ids by ranks, under the pre-token pattern of byte-level vocabularies."""
    import tiktoken

    return tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class ByteLevel:
    """Ids and pre-tokens of texts under a tokenizers .json file at ``path``, as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        #: Whether a text may be parted into pre-tokens that have the same pieces wherever they stand.
        self.parts_alone = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        )
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        ranks = _ranks(spec["model"]) if self.parts_alone else None
        self.merger = _merger(ranks) if ranks else None
        self.find = regex.compile(PATTERN).findall

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between added tokens and these, and whether a part is one of the former."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if part:
                yield part, i % 2 == 0

    def ids(self, text: str) -> array:
        """The ids of one text, span by span, as unsigned 32-bit integers."""
        out = array("I")
        if self.merger is None:
            out.extend(self._library(text))
            return out
        for part, plain in self._parts(text):
            if plain and not OTHER_SPACE.search(part):
                for span in spans(part):
                    out.extend(self.merger(span))
            else:
                out.extend(self._library(part))
        return out

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of one text, span by span, an added token as one; only where ``parts_alone``."""
        for part, plain in self._parts(text):
            if not plain:
                yield [part]
                continue
            for span in spans(part):
                if UNSTEADY.search(span):
                    yield [span[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(span)]
                else:
                    yield self.find(span)

    def sizes(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        return list(map(len, self.tokenizer.encode_batch(texts, add_special_tokens=False)))


@lru_cache(4)
def byte_level(path: str) -> ByteLevel:
    """One for each file and Python worker, as workers outlive tasks."""
    return ByteLevel(path)
