"""Sizes in tokens of a public tokenizer (byte-level BPE given as ranks).

Texts go through numpy as flat code points: the split into pretokens (a word with its blank) is a few
shifts of an array of character classes, each pretoken is looked up under a 64-bit hash, and only
pretokens that a worker has not met go to the tokenizer. A token never spans two pretokens, so sizes add up.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import tiktoken

from quillspark.llm.codepoints import flatten

#: Where the public vocabularies lie, and the one used unless another is named.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"
#: The published split pattern of this family of tokenizers. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that go through numpy at once, and known pretokens at which a worker forgets them; only
#: memory and time depend on them.
CHARS_AT_ONCE, REMEMBERED = 1 << 20, 1 << 20

SEP, SPACE, LETTER, NUMBER, OTHER = range(5)


@cache
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(0x32400):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85):
            out[c] = SPACE
    out[0] = SEP
    return out


@cache
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per character, and the powers of an odd number and of its inverse."""
    rng = np.random.default_rng(20240)
    base = int(rng.integers(1 << 62)) * 2 + 1
    size = 2 * CHARS_AT_ONCE
    powers = np.full(size, base, dtype=np.uint64)
    inverse = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    powers[0] = inverse[0] = 1
    return rng.integers(1, 1 << 63, 0x32400, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of a flat array."""
    salt, power, inverse = _hashing()
    if len(flat) > len(power):  # one very long text: in stretches of its own
        out = np.zeros(len(begin), dtype=np.uint64)
        at = 0
        while at < len(begin):
            stop = max(at + 1, int(np.searchsorted(end, begin[at] + CHARS_AT_ONCE)))
            a, b = int(begin[at]), int(end[stop - 1])
            if b - a > len(power):  # a single word of more than a million characters
                out[at] = np.uint64(hash(flat[a:b].tobytes()) & (1 << 64) - 1)
            else:
                out[at:stop] = hashes(flat[a:b], begin[at:stop] - a, end[at:stop] - a)
            at = stop
        return out
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(salt[np.minimum(flat, 0x323FF)] * power[: len(flat)], out=sums[1:])
    return (sums[end] - sums[begin]) * inverse[begin]


def pretoken_starts(flat: np.ndarray) -> np.ndarray:
    """Where pretokens begin in a flat array (a separator is one of its own)."""
    kind = _classes()[np.minimum(flat, sys.maxunicode)]
    before = np.concatenate(([SEP], kind[:-1]))
    start = kind != before
    start |= kind == SEP
    run = np.flatnonzero(start & (kind >= LETTER) & (before == SPACE))  # words after white space
    start[run - 1] = True
    start[run[flat[run - 1] == 0x20]] = False
    quote = np.flatnonzero((flat == 0x27) & start)
    quote = quote[(kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.concatenate((flat, [0, 0, 0]))
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, n in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            start[q + n + 1] |= kind[q + n + 1] == LETTER
    return np.flatnonzero(start)


class Tokenizer:
    """Counts tokens of texts and of their pretokens."""

    def __init__(self, name: str, folder: str):
        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known, self._sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._bits = 20
        self._slot = np.full(1 << self._bits, -1, dtype=np.int32)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Sizes under the hashes; -1 where unknown."""
        if not len(self._known):
            return np.full(len(h), -1, dtype=np.int64)
        slot = self._slot[self._place(h)]
        at = np.maximum(slot, 0)
        out = np.where((slot >= 0) & (self._known[at] == h), self._sizes[at], -1)
        rest = np.flatnonzero((out < 0) & (slot >= 0))
        if len(rest):
            at = np.minimum(np.searchsorted(self._known, h[rest]), len(self._known) - 1)
            out[rest] = np.where(self._known[at] == h[rest], self._sizes[at], -1)
        return out

    def _learn(self, h: np.ndarray, sizes: np.ndarray) -> None:
        if len(self._known) > REMEMBERED:
            self._known, self._sizes = self._known[:0], self._sizes[:0]
        known, sizes = np.concatenate((self._known, h)), np.concatenate((self._sizes, sizes))
        order = np.argsort(known, kind="stable")
        self._known, self._sizes = known[order], sizes[order]
        self._slot[:] = -1
        self._slot[self._place(self._known)] = np.arange(len(known))

    def pretokens(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and size in tokens of every pretoken of a flat array; separators have size 0."""
        begin = pretoken_starts(flat)
        end = np.append(begin[1:], len(flat))
        h = hashes(flat, begin, end)
        size = self._find(h)
        size[flat[begin] == SEP] = 0
        new = np.flatnonzero(size < 0)
        if len(new):
            values, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            text = [flat[begin[i] : end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace") for i in new[first].tolist()]
            counts = np.array([self.count(x) for x in text], dtype=np.int64)
            size[new] = counts[back]
            self._learn(values, counts)
        return begin, end, size

    def flat_batches(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The texts in stretches of bounded size: index of the first, its flat array, starts, pretokens."""
        first, size = 0, 0
        for i, x in enumerate([*texts, None]):
            size += len(x) + 1 if x else 1
            if i == len(texts) or (size > CHARS_AT_ONCE and i > first):
                if i > first:
                    flat, starts = flatten([(y or "").replace("\0", "\1") for y in texts[first:i]])
                    yield first, flat, starts, self.pretokens(flat)
                first, size = i, len(x or "") + 1

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; 0 for null."""
        out = np.zeros(len(texts), dtype=np.int64)
        for first, _, starts, (begin, _, size) in self.flat_batches(texts):
            total = np.concatenate(([0], np.cumsum(size)))
            at = np.searchsorted(begin, np.append(starts, begin[-1]))
            out[first : first + len(starts)] = total[at[1:]] - total[at[:-1]]
        return out


@cache
def tokenizer(name: str = DEFAULT, folder: str = VOCABULARIES) -> Tokenizer:
    return Tokenizer(name, folder)
