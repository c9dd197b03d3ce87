"""Words of many texts at once, as places in one buffer, and a table that finds them by their hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: A-Z become a-z; the six ASCII blanks part words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SOLID = bytes(c not in (9, 10, 11, 12, 13, 32) for c in range(256))
#: Bytes that are hashed at once.
CHUNK = 1 << 18
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64."""
    out = []
    for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        steps = np.full(CHUNK, f, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Words:
    """The words of texts, lower-cased: of each where it starts and stops in ``data``, and its hash.

    ``counts``: how many words each text has.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.data = b"\n".join(parts).translate(LOWER) + b"\n" * 8  # so that eight bytes can be read from any place
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        solid = np.frombuffer(b"\0" + self.data.translate(SOLID), dtype=bool)  # its end is blank
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.stops = edges[::2].copy(), edges[1::2].copy()
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A polynomial in the bytes of each word, well spread; never 0."""
        up, down = _powers()
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            first = self.starts[i]
            j = int(np.searchsorted(self.stops, first + CHUNK, side="right"))
            if j <= i:  # a word of more bytes than a chunk
                total = 0
                for k, at in enumerate(range(first, self.stops[i], CHUNK)):
                    piece = self.bytes[at : min(at + CHUNK, self.stops[i])].astype(np.uint64) + np.uint64(1)
                    total += int((piece * up[: len(piece)]).sum()) * pow(_FACTOR, k * CHUNK, 1 << 64)
                out[i] = total % (1 << 64)
                i += 1
                continue
            x = self.bytes[first : self.stops[j - 1]].astype(np.uint64)
            x += np.uint64(1)
            x *= up[: len(x)]
            sums = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(x, out=sums[1:])
            a, b = self.starts[i:j] - first, self.stops[i:j] - first
            out[i:j] = (sums[b] - sums[a]) * down[a]
            i = j
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
        out[out == 0] = 1
        return out

    def spelt(self, at: np.ndarray) -> list[bytes]:
        """Some of the words, by number."""
        return [self.data[i:j] for i, j in zip(self.starts[at].tolist(), self.stops[at].tolist(), strict=True)]


    def eights(self) -> np.ndarray:
        """The eight bytes from each place of ``data`` on, as one number."""
        return np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))

    def fronts(self) -> np.ndarray:
        """The first eight bytes of each word as one number, 0 behind its end."""
        unused = 8 * (8 - np.minimum(self.stops - self.starts, 8))
        return self.eights()[self.starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused.astype(np.uint64))


class WordTable:
    """A value for each of some distinct words. Hashes tell where to look; a word is found if its bytes are the same."""

    def __init__(self, words: list[bytes], values: np.ndarray):
        self.words, self.values = Words([b" ".join(words).decode()]), values
        hashes = self.words.hashes
        self.fronts, self.sizes = self.words.fronts(), self.words.stops - self.words.starts
        bits = max(4, (2 * len(words)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int64)
        todo, at = np.arange(len(words)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[at[todo]] == 0)
            slots, one = np.unique(at[todo[free]], return_index=True)
            placed = todo[free[one]]
            self.keys[slots], self.numbers[slots] = hashes[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _same(self, words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` of over eight bytes go on like the table's words ``b`` of the same length and first eight
        bytes: eight at a time, of fewer and fewer words."""
        own, ours = words.eights(), self.words.eights()
        x, y = words.starts[a] + 8, self.words.starts[b] + 8
        left = words.stops[a] - x
        same, todo = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(todo):
            unused = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
            differ = (own[x] ^ ours[y]) << unused != 0
            same[todo[differ]] = False
            go = np.flatnonzero(~differ & (left > 8))
            todo, x, y, left = todo[go], x[go] + 8, y[go] + 8, left[go] - 8
        return same

    def find(self, words: Words) -> np.ndarray:
        """The value of each word, -1 for those that the table does not have."""
        hashes, fronts, sizes = words.hashes, words.fronts(), words.stops - words.starts
        at = (hashes >> self.shift).astype(np.int64)
        out, todo = np.full(len(hashes), -1, dtype=np.int64), None
        while todo is None or len(todo):
            of = (lambda x: x) if todo is None else (lambda x: x[todo])  # noqa: B023
            key = self.keys[of(at)]
            may, gone = np.flatnonzero(key == of(hashes)), key == 0
            word = may if todo is None else todo[may]
            number = self.numbers[at[word]]
            same = (self.fronts[number] == fronts[word]) & (self.sizes[number] == sizes[word])
            long = np.flatnonzero(same & (sizes[word] > 8))
            same[long] = self._same(words, word[long], number[long])
            out[word[same]] = self.values[number[same]]
            gone[may[same]] = True
            todo = np.flatnonzero(~gone) if todo is None else todo[~gone]
            at[todo] = (at[todo] + 1) & self.mask
        return out
