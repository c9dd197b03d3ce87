"""Encoding and decoding with a byte-fallback BPE model of the sentencepiece format."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
CHARACTER = 1 << 21  # symbols from here on are characters that are no piece
NEVER = np.iinfo(np.int32).max


class PieceCodec:
    """ids of texts and texts of ids, as the library gives them, from the model file alone.

    Merges run in rounds over one flat array of symbols for many words: the least rank of a pair within each
    word is found, all its places in the word are merged at once, leftmost first where they overlap, and the
    array is closed up, until no word has a pair. Where a merge could make a pair of the same or a better rank,
    only its leftmost place is merged in a round, so that the order stays that of the library. Words seen
    before come from a bounded table.
    """

    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, norm = model.trainer_spec, model.normalizer_spec
        if trained.model_type != 2 or not trained.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only byte-fallback BPE models with identity normalisation are read")
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in plain) or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces across words are not supported")
        self.n = len(model.pieces)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (trained.eos_piece or "</s>"))
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.bytes_of = [b""] * self.n
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == p.NORMAL:
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == p.UNKNOWN:
                self.bytes_of[i] = " ⁇ ".encode()
        # A word with the blanks before it: no piece joins a visible character to a blank after it, so words merge alone.
        # Of a long run of blanks, as many as the longest piece of blanks has are cut off at a time while more follow.
        self.blanks = max((len(p) for p in plain if not p.strip(SPACE)), default=1)
        self.words = re.compile(f"{SPACE}{{{self.blanks}}}(?={SPACE})|{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.single = {p: i for p, i in plain.items() if len(p) == 1}
        symbol = lambda s: plain.get(s, CHARACTER + ord(s) if len(s) == 1 else None)
        scores = np.array([model.pieces[i].score for i in plain.values()])
        rank_of = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        pairs: dict[int, tuple[int, int]] = {}
        unsafe = set()
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 22 | b] = (rank_of[piece], i)
                    unsafe |= {x for x in (piece[:k], piece[k:]) if len(x) > 1 and rank_of[x] >= rank_of[piece]}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.one_by_one = np.zeros(max(rank_of.values()) + 1, dtype=bool)
        self.one_by_one[[rank_of[x] for x in unsafe]] = True
        self.most, self.table, self.before = most, {}, {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in the table of pairs each pair is, or -1."""
        keys = left << 22 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, one word after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        distinct, back = np.unique(points, return_inverse=True)
        symbols = np.array([self.single.get(chr(p), CHARACTER + p) for p in distinct.tolist()], dtype=np.int64)[back]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbols), -1, dtype=np.int64)  # of each symbol and the next
        inside = word[:-1] == word[1:]
        pair[:-1][inside] = self._pairs(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            rank = np.where(pair >= 0, self.ranks[pair], NEVER)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            if (over := least == NEVER).any():
                out = np.repeat(over, sizes)
                done.append((word[out], symbols[out]))
                symbols, word, pair, rank = symbols[~out], word[~out], pair[~out], rank[~out]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])  # overlapping places: every other one
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            if (slow := self.one_by_one[rank[hit]]).any():
                hit = hit[~slow | np.r_[True, word[hit][1:] != word[hit][:-1]]]
            symbols[hit] = self.merged[pair[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            hit -= np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                joined = at[at + 1 < len(word)]
                joined = joined[word[joined] == word[joined + 1]]
                pair[at] = -1
                pair[joined] = self._pairs(symbols[joined], symbols[joined + 1])
        none = np.empty(0, dtype=np.int64)
        of, flat = np.concatenate([none, *(w for w, _ in done)]), np.concatenate([none, *(s for _, s in done)])
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word; a character that is no piece has those of its bytes."""
        symbols, sizes = self.merge(words)
        if len(odd := np.flatnonzero(symbols >= CHARACTER)):
            spelt = [self.byte_id[list(chr(s - CHARACTER).encode())] for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[odd] = [len(x) for x in spelt]
            sizes = np.add.reduceat(times, np.cumsum(sizes) - sizes)
            symbols = np.repeat(symbols, times)
            symbols[symbols >= CHARACTER] = np.concatenate(spelt)
        data, ends = symbols.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def encode(self, texts: list[str], end: bool = False) -> list[np.ndarray]:
        if len(self.table) > self.most // 2:  # words of the table before last go, those met again come along
            self.table, self.before = {}, self.table
        table, before = self.table, self.before
        words = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new: set[str] = set()
        for own in words:
            new.update(own)
        new.difference_update(table)
        table.update((w, before[w]) for w in new if w in before)
        if missing := sorted(new.difference(before), key=len):
            start = 0
            while start < len(missing):  # words of like length together, about a million symbols at a time
                stop = start + max(1, (1 << 20) // len(missing[min(start + 4096, len(missing)) - 1]))
                part = missing[start:stop]
                table.update(zip(part, self._ids(part), strict=True))
                start = stop
        last = np.array([self.end], dtype="<i4").tobytes() if end else b""
        return [np.frombuffer(b"".join(map(table.__getitem__, own)) + last, dtype="<i4") for own in words]

    def decode(self, ids: np.ndarray) -> str:
        """Blanks for the blank sign, none for the first; bytes that are no character give U+FFFD each."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return _characters(data[1:] if data[:1] == b" " else data)


def _characters(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "\ufffd")
            data = data[e.start + 1 :]
    return "".join(out)


@lru_cache(2)
def piece_codec(path: str) -> PieceCodec:
    """One for each file and Python worker."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: the ids with an end id only, and their text decoded again.

    A null text is empty: the end id alone, decoded to the empty text. A null id stays null, repeated rows are
    encoded each, other columns are ignored, an empty table gives an empty one. Texts are never cut.
    """

    def make():
        codec = piece_codec(model)

        def work(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            ids = codec.encode(texts, end=True)
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists, pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

        return work

    return map_texts(docs, make, "doc_id long, ids array<int>, decoded string", id_col, text_col)
