"""Problem 7: held-out passages that appear in corpus documents.

Pigeonhole edit matching over words. Half a passage (``L`` words) with at most ``k`` words changed, dropped or
added is searched by pieces of ``w`` words: any ``L`` words of the passage hold ``(L - w + 1) // w`` whole pieces,
an error touches one piece at most, so all but ``k`` of them are in the text unchanged (``k + 1`` pieces would
promise one hit; fixed pieces promise several, a stronger filter). Every document's runs of ``w`` words are looked
up among the pieces, and where enough hits lie close by, every half of the passage is verified with Myers'
bit-parallel edit distance, in as many 64-bit blocks as the half is long. A bound that never loses a match comes
before it: enough words near the hit must be words of the item.

Words are compared in their consistent form, without case, punctuation, layout and markup; a hyphen
inside a word, also at a line end, doesn't count. Items are searched in one pass over the documents, or in one pass
per ``BLOCK_CHARS`` characters of items, which is what is broadcast at once; documents are never shuffled. Null and
empty texts and items have no matches; repeated rows of either side give one row.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.canonical import canonical_arrow
from quillspark.llm.codepoints import flatten_arrow
from quillspark.llm.tokens import CHARS_AT_ONCE, hashes

SHARE, ERRORS, PIECE, BLOCK_CHARS = 0.5, 0.1, 5, 32_000_000
#: Verifications that run side by side, and cells of a table of words; memory alone depends on them.
LANES, CELLS = 50_000, 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tags, comments and the targets of links.
MARKUP = r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"


@cache
def _lookup() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    word = np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(0x32400):
        ch = chr(c)
        word[c] = unicodedata.category(ch)[0] in "LNM"
        if len(x := ch.lower()) == 1:
            lower[c] = ord(x)
    return lower, word


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and the index of its text."""
    flat, _ = flatten_arrow(canonical_arrow(texts, by_text=False))
    lower, word = _lookup()
    inside = word[flat]
    hyphen = np.flatnonzero(flat[1:-2] == 0x2D) + 1
    hyphen = hyphen[inside[hyphen - 1]]
    broken = hyphen[(flat[hyphen + 1] == 0x0A) & inside[hyphen + 2]]
    keep = np.ones(len(flat), dtype=bool)
    keep[hyphen[inside[hyphen + 1]]] = False
    keep[broken] = keep[broken + 1] = False
    flat, inside = lower[flat[keep]], inside[keep]
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hashes(flat, begin, end), np.searchsorted(np.flatnonzero(flat == 0), begin) - 1


def _runs(h: np.ndarray, w: int) -> np.ndarray:
    """A hash of every run of ``w`` words."""
    n = max(0, len(h) - w + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(w):
        out = out * MIX + h[j : j + n]
    return out ^ (out >> np.uint64(29))


class Table:
    """Exact membership of 64-bit hashes, with a bit table in front."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self._slot(self.values)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(42)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known hashes, and their places among the sorted values."""
        at = np.flatnonzero(self.bits[self._slot(h)]) if len(self.values) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, h[at]), max(0, len(self.values) - 1))
        good = self.values[place] == h[at] if len(at) else np.zeros(0, bool)
        return at[good], place[good]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]``, ``first[i] + 1``, ... (``n[i]`` of them), one stretch after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Items:
    """The pieces and words of a block of items, all in flat arrays."""

    def __init__(self, ids: np.ndarray, passages: pa.Array, share: float, errors: float):
        h, which = words(passages)
        self.ids = ids
        self.begin = np.searchsorted(which, np.arange(len(ids) + 1))
        size = np.diff(self.begin)
        self.need = np.ceil(size * share - 1e-9).astype(np.int64)
        self.errors = (errors * self.need + 1e-9).astype(np.int64)
        self.piece = np.full(len(ids), PIECE)
        for _ in range(PIECE - 1):
            self.piece -= (self.piece > 1) & ((self.need - self.piece + 1) // self.piece <= self.errors)
        self.hits = np.maximum(1, (self.need - self.piece + 1) // self.piece - self.errors)
        self.vocabulary = Table(h)
        self.words = np.searchsorted(self.vocabulary.values, h)
        # Which words an item holds: sorted pairs of item and word, an item's in one stretch.
        self.wide = len(self.vocabulary.values) + 1
        pairs = which.astype(np.int64) * self.wide + self.words
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.held = Table(self.pairs.astype(np.uint64) * MIX)
        order = np.argsort(self.pairs.astype(np.uint64) * MIX, kind="stable")
        self.held_pair = order
        self.pair_begin = np.searchsorted(self.pairs, np.arange(len(ids) + 1) * self.wide)
        self.pieces = {}
        for w in np.unique(self.piece[size > 0]).tolist():
            mine = np.flatnonzero((self.piece == w) & (size >= w))
            n = size[mine] // w
            place = np.repeat(self.begin[mine], n) + w * _ranges(np.zeros(len(mine), np.int64), n)
            value = _runs(h, w)[place]
            order = np.argsort(value, kind="stable")
            table, value = Table(value), value[order]
            first = np.searchsorted(value, table.values)
            self.pieces[w] = (table, first, np.append(first[1:], len(value)), np.repeat(mine, n)[order])

    def _pair_of(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each pair of item and word among ``pairs``; -1 for a word that the item lacks."""
        key = (item.astype(np.int64) * self.wide + word).ravel()
        out = np.full(key.shape, -1, dtype=np.int64)
        at, place = self.held.find(key.astype(np.uint64) * MIX)
        out[at] = self.held_pair[place]
        return out.reshape(np.broadcast_shapes(item.shape, word.shape))

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and item that match, by their places."""
        h, which = words(texts)
        bounds = np.searchsorted(which, np.arange(len(texts) + 1))
        at, place = self.vocabulary.find(h)
        ids = np.full(len(h), self.wide - 1, dtype=np.int64)
        ids[at] = place
        pairs = []
        for w, (table, first, stop, item) in self.pieces.items():
            pos, place = table.find(_runs(h, w))
            inside = pos + w <= bounds[which[pos] + 1]
            pos, place = pos[inside], place[inside]
            n = stop[place] - first[place]
            pairs.append(np.stack((np.repeat(pos, n), item[_ranges(first[place], n)])))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, item = np.concatenate(pairs, axis=1)
        # Of the whole pieces in any half of an item, all but as many as there may be errors are hit, close by.
        order = np.lexsort((pos, item, which[pos]))
        pos, item = pos[order], item[order]
        span = (self.need + self.errors)[item]
        last = np.arange(len(pos)) + self.hits[item] - 1
        there = last < len(pos)
        last = np.minimum(last, max(0, len(pos) - 1))
        keep = there & (item[last] == item) & (which[pos[last]] == which[pos]) & (pos[last] - pos < span)
        pos, item, span = pos[keep], item[keep], span[keep]
        # Runs that begin in the same stretch of a text are verified together.
        key = np.unique(np.stack((which[pos], item, pos // np.maximum(1, span))), axis=1)
        return self._verified(ids, bounds, *key)

    def _verified(self, ids: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = (self.need + self.errors)[item]
        order = np.argsort(span, kind="stable")
        text, item, block, span = text[order], item[order], block[order], span[order]
        lo = np.maximum(bounds[text], block * span - span)
        hi = np.minimum(bounds[text + 1], (block + 2) * span)
        good = np.zeros(len(text), dtype=bool)
        a = 0
        while a < len(text):  # the bound: words of the item among the words near a hit
            s = slice(a, a + max(1, CELLS // int(3 * span[min(len(text) - 1, a + CELLS // 300)] + 1)))
            where = lo[s, None] + np.arange(int((hi[s] - lo[s]).max()))
            mine = (self._pair_of(np.broadcast_to(item[s, None], where.shape), ids[np.minimum(where, len(ids) - 1)]) >= 0) & (where < hi[s, None])
            sums = np.concatenate((np.zeros((len(mine), 1), np.int32), np.cumsum(mine, axis=1, dtype=np.int32)), axis=1)
            begin = np.arange(sums.shape[1])
            best = (np.take_along_axis(sums, np.minimum(begin + span[s, None], sums.shape[1] - 1), axis=1) - sums).max(axis=1)
            good[s] = best >= (self.need - self.errors)[item[s]]
            a = s.stop
        text, item, lo, hi = text[good], item[good], lo[good], hi[good]
        found = np.zeros(len(text), dtype=bool)
        blocks = -(-self.need[item] // 64)
        windows = np.diff(self.begin)[item] - self.need[item] + 1
        for n in np.unique(blocks).tolist():
            rows = np.flatnonzero(blocks == n)
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(windows[rows]) // max(1, LANES // n))) + 1):
                found[part] = self._near(ids, item[part], windows[part], lo[part], hi[part], n)
        return text[found], item[found]

    def _near(self, ids: np.ndarray, item: np.ndarray, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray, blocks: int) -> np.ndarray:
        """Whether some half of each item lies in its stretch of words within its errors (Myers); every half
        of every item runs in a lane of its own, in ``blocks`` words of 64 bits."""
        one, zero = np.uint64(1), np.uint64(0)
        # Where each of an item's words stands in it, as bits; the first row is that of all other words.
        used, slot = np.unique(item, return_inverse=True)
        n_pairs = self.pair_begin[used + 1] - self.pair_begin[used]
        base = 1 + np.cumsum(n_pairs) - n_pairs
        sizes = self.begin[used + 1] - self.begin[used]
        masks = np.zeros((1 + int(n_pairs.sum()), int(sizes.max()) // 64 + 2), dtype=np.uint64)
        at = self.pair[_ranges(self.begin[used], sizes)] + np.repeat(base - self.pair_begin[used], sizes)
        bit = _ranges(np.zeros(len(used), np.int64), sizes)
        np.bitwise_or.at(masks, (at, bit >> 6), one << (bit & 63).astype(np.uint64))
        length = int((hi - lo).max())
        where = lo[:, None] + np.arange(length)
        pair = self._pair_of(np.broadcast_to(item[:, None], where.shape), np.where(where < hi[:, None], ids[np.minimum(where, len(ids) - 1)], self.wide - 1))
        place = np.where(pair >= 0, pair + (base - self.pair_begin[used])[slot][:, None], 0)
        row = np.repeat(np.arange(len(item)), windows)
        start = _ranges(np.zeros(len(item), np.int64), windows)
        shift, skip = (start & 63).astype(np.uint64), start >> 6
        up, shifted = (np.uint64(64) - shift) & np.uint64(63), shift > 0
        need, errors = self.need[item][row], self.errors[item][row]
        top = ((need - 1) & 63).astype(np.uint64)
        last = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - top)
        full = [last if b == blocks - 1 else np.uint64(0xFFFFFFFFFFFFFFFF) for b in range(blocks)]
        pv = [np.full(len(row), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64) & full[b] for b in range(blocks)]
        mv = [np.zeros(len(row), dtype=np.uint64) for _ in range(blocks)]
        score = need.copy()
        best = score.copy()
        for t in range(length):
            at = place[row, t]
            plus = minus = zero  # what a block hands on to the next
            for b in range(blocks):
                eq = masks[at, skip + b] >> shift
                eq = (eq | np.where(shifted, masks[at, skip + b + 1] << up, zero)) & full[b]
                xv = eq | mv[b]
                eq = eq | minus
                xh = (((eq & pv[b]) + pv[b]) ^ pv[b]) | eq
                ph = mv[b] | ~(xh | pv[b])
                mh = pv[b] & xh
                out = top if b == blocks - 1 else np.uint64(63)
                up_by, down_by = (ph >> out) & one, (mh >> out) & one
                ph, mh = ph << one | plus, mh << one | minus
                pv[b] = (mh | ~(xv | ph)) & full[b]
                mv[b] = ph & xv & full[b]
                plus, minus = up_by, down_by
            score += plus.astype(np.int64) - minus.astype(np.int64)
            np.minimum(best, score, out=best)
        found = np.zeros(len(item), dtype=bool)
        found[row[best <= errors]] = True
        return found


def _plain(text: Column) -> Column:
    return F.when(text.contains("<") | text.contains("]("), F.regexp_replace(text, MARKUP, " ")).otherwise(text)


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of ``documents`` (doc_id, text) and ``items`` (item_id, passage) where the text has one
    stretch with at least ``share`` of the passage's words: doc_id, item_id."""
    rows = items.filter(F.col("passage").isNotNull()).select("item_id", _plain(F.col("passage")).alias("passage")).distinct()
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", _plain(F.col("text")).alias("text"))
    chars = rows.agg(F.sum(F.length("passage").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    parts = None
    for number in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow()  # about ``block_chars``
        found = _leaks_of(mine, texts, share, errors)
        parts = found if parts is None else parts.unionAll(found)
    return parts.distinct()


#: The items that a Python worker last searched for; it serves many tasks.
_LAST: dict[str, Items] = {}


def _leaks_of(rows: pa.Table, texts: DataFrame, share: float, errors: float) -> DataFrame:
    known = texts.sparkSession.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = Items(known.value.column("item_id").to_numpy(), known.value.column("passage").combine_chunks(), share, errors)
        items = _LAST[name]
        for batch in batches:
            docs, all_texts = batch.column("doc_id"), batch.column("text")
            size = np.cumsum(pc.binary_length(all_texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size // CHARS_AT_ONCE)) + 1):
                if len(part) and len(items.ids):
                    text, item = items.matches(all_texts.slice(part[0], len(part)))
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(text + part[0])).cast(pa.int64()), pa.array(items.ids[item], pa.int64())], names=["doc_id", "item_id"])

    return texts.mapInArrow(run, "doc_id long, item_id long")
