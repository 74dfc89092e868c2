"""Problem 8: items larger than a limit cut into pieces at natural boundaries.

Agglomerative merging: a text begins as atomic segments (lines and sentences; clauses, then words, where those
are too large), every adjacent pair lies in a heap under the strength of the boundary between them, and
the weakest boundaries are merged first while the combined size plus the overlap fits. What remains are
the cores of the pieces, whose boundaries are the strongest available; each later piece begins with the
last words before its core that fit into the overlap.

Sizes are tokens of a public tokenizer and cuts fall between its pretokens (a pretoken larger than what
fits is cut between characters). Pretokens, sizes and boundaries of a batch are found at once in numpy;
only the heap runs text by text. Texts within the limit, null and empty texts have no pieces. Repeated
rows are cut alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.codepoints import column
from quillspark.llm.tokens import DEFAULT, SPACE, VOCABULARIES, Tokenizer, _classes, tokenizer

LIMIT, OVERLAP = 512, 32
# Marks after which a sentence or a clause may end; the wide ones need no blank after them.
SENTENCE, SENTENCE_WIDE, CLAUSE, CLAUSE_WIDE = ".!?…", "。！？", ",;:", "、；：，"
PARAGRAPH_END, LINE_END, SENTENCE_END, CLAUSE_END, WORD_END, INSIDE_WORD = 5, 4, 3, 2, 1, 0


@cache
def _marks() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.uint8)
    for kind, marks in enumerate(("\n", SENTENCE, SENTENCE_WIDE, CLAUSE, CLAUSE_WIDE), 1):
        table[[ord(c) for c in marks]] = kind
    return table


def boundary_strengths(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The strength of the boundary after each pretoken."""
    kind = _marks()[np.minimum(flat, 0xFFFF)]
    at = np.flatnonzero(kind)
    token = np.searchsorted(begin, at, side="right") - 1

    def holds(*bits: int) -> np.ndarray:
        return np.bincount(token[np.isin(kind[at], bits)], minlength=len(begin))

    blank = _classes()[np.minimum(flat[end - 1], 0x323FF)] == SPACE
    before_blank = np.append(_classes()[np.minimum(flat[begin[1:]], 0x323FF)] == SPACE, True)
    lines = np.where(blank, holds(1), 0)
    earlier = np.concatenate(([0], lines[:-1]))
    out = np.full(len(begin), WORD_END, dtype=np.int8)
    out[~blank & (((holds(4) > 0) & before_blank) | (holds(5) > 0))] = CLAUSE_END
    out[~blank & (((holds(2) > 0) & before_blank) | (holds(3) > 0))] = SENTENCE_END
    # White space goes with what is before it, so the boundary lies after it.
    follows = np.append(blank[1:], False)
    after = np.concatenate(([WORD_END], out[:-1]))
    out = np.where(blank, np.where(lines + earlier > 1, PARAGRAPH_END, np.where(lines > 0, LINE_END, after)), out)
    return np.where(follows & (out < LINE_END), WORD_END, out).astype(np.int8)


def _merge(size: list[int], strength: list[int], room: int) -> list[int]:
    """Indexes of the last segment of each core, after merging the weakest boundaries first."""
    n = len(size)
    size = list(size)
    after, before, live, end = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, list(range(n))
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, both, a, b = heapq.heappop(heap)
        if not (live[a] and live[b]) or after[a] != b or size[a] + size[b] != both:
            continue
        size[a], live[b], end[a], c = both, False, end[b], after[b]
        after[a] = c
        if c < n:
            before[c] = a
            if both + size[c] <= room:
                heapq.heappush(heap, (strength[end[a]], both + size[c], a, c))
        z = before[a]
        if z >= 0 and size[z] + both <= room:
            heapq.heappush(heap, (strength[end[z]], size[z] + both, z, a))
    return [end[i] for i in range(n) if live[i]]


def _by_characters(word: str, room: int, tok: Tokenizer) -> tuple[list[int], list[int]]:
    """Lengths and sizes of the parts of one pretoken that is larger than ``room``."""
    lengths, sizes, at = [], [], 0
    while at < len(word):
        step = room
        while step > 1 and tok.count(word[at : at + step]) > room:
            step //= 2
        piece = word[at : at + step]
        at += len(piece)
        lengths.append(len(piece)), sizes.append(tok.count(piece))
    return lengths, sizes


def _pieces(text: str, length: np.ndarray, size: np.ndarray, strength: np.ndarray, tok: Tokenizer, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces of one text as (begin, core begin, end, tokens), from its pretokens."""
    room = limit - overlap
    if size.max() > room:
        parts_l, parts_s, parts_b, at = [], [], [], 0
        for n, s, b in zip(length.tolist(), size.tolist(), strength.tolist()):
            ls, ss = _by_characters(text[at : at + n], room, tok) if s > room else ([n], [s])
            parts_l += ls
            parts_s += ss
            parts_b += [INSIDE_WORD] * (len(ls) - 1) + [b]
            at += n
        length, size, strength = np.array(parts_l), np.array(parts_s), np.array(parts_b)
    ends, total = np.cumsum(length), np.concatenate(([0], np.cumsum(size)))
    first, last = np.zeros(1, dtype=np.int64), np.array([len(size) - 1])
    for least in (SENTENCE_END, CLAUSE_END, INSIDE_WORD):  # segments beyond the room begin as smaller ones
        large = total[last + 1] - total[first] > room
        if not large.any():
            break
        inside = np.repeat(large, last - first + 1)
        last = np.unique(np.concatenate((last, np.flatnonzero(inside & (strength >= least)))))
        first = np.concatenate(([0], last[:-1] + 1))
    kept = _merge((total[last + 1] - total[first]).tolist(), strength[last].tolist(), room)
    places = np.concatenate(([0], ends))
    out, core = [], 0
    for z in last[kept].tolist():
        stop = z + 1
        start = int(np.searchsorted(total, total[core] - overlap)) if core else 0
        n = int(total[stop] - total[start])
        a, c, b = int(places[start]), int(places[core]), int(places[stop])
        if text[max(a, b - 2) : b].isspace():  # white space at the end of a text is one pretoken
            blank = len(text[a:b].rstrip())
            n += tok.count(text[a + blank : b]) - int(total[stop] - total[max(start, np.searchsorted(places, a + blank))])
        if INSIDE_WORD in strength[max(start - 1, 0) : stop]:
            n = tok.count(text[a:b])
        while n > limit and start < core:  # joined anew, words at the edge may count differently
            start += 1
            a = int(places[start])
            n = tok.count(text[a:b])
        out.append((a, c, b, n))
        core = stop
    return out


def split(texts: list[str | None], tok: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """The index and pieces of every text beyond ``limit``."""
    for first, flat, starts, (begin, end, size) in tok.flat_batches(texts):
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.searchsorted(begin, np.append(starts, begin[-1]))
        beyond = np.flatnonzero(total[at[1:]] - total[at[:-1]] > limit)
        if not len(beyond):
            continue
        strength, length = boundary_strengths(flat, begin, end), end - begin
        for i in beyond.tolist():
            a, z = int(at[i]), int(at[i + 1])
            z -= int(flat[begin[z - 1]] == 0)
            yield first + i, _pieces(texts[first + i], length[a:z], size[a:z], strength[a:z], tok, limit, overlap)


def split_oversized(df: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP, name: str = DEFAULT, folder: str = VOCABULARIES) -> DataFrame:
    """Pieces of the texts of ``df`` (``key``, ``text``) beyond ``limit`` tokens: key, ``piece_no``,
    ``char_begin``, ``core_begin``, ``char_end``, ``n_tokens``, ``piece``. Cores tile the text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    fields = [(f"`{key}` {df.schema[key].dataType.simpleString()}")] + ["piece_no bigint", "char_begin bigint", "core_begin bigint", "char_end bigint", "n_tokens bigint", "piece string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            keys, texts, rows = column(batch, key), column(batch, "text"), []
            for row, pieces in split(texts, tok, limit, overlap):
                rows += [(keys[row], i, a, c, b, n, texts[row][a:b]) for i, (a, c, b, n) in enumerate(pieces)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [batch.schema.field(key).type, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[key, "piece_no", "char_begin", "core_begin", "char_end", "n_tokens", "piece"])

    # A token is at least one byte, so a text of no more bytes than the limit is within it.
    large = df.filter(F.octet_length("text") > limit).select(key, "text")
    return large.mapInArrow(run, ", ".join(fields))
