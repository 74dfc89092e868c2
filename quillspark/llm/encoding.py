"""Problem 5: text that was decoded with a wrong character encoding.

A hidden Markov model has one clean state and one state per encoding pair (UTF-8 bytes read in a
single-byte encoding, or single-byte text read in another single-byte encoding), plus a state for
characters that are lost. A character's emission in the clean state is its probability after the class of
the character before it, counted over all characters that are in no decodable sequence and not out of place
in a Latin word. In a UTF-8 pair's state, a sequence that decodes to one character has that character's
clean probability, and anything else nearly none; in a single-byte pair's state, every character has the
clean probability of what its byte was. Viterbi labels the characters; each labelled span is put through
its state's inverse, again until nothing changes (text garbled twice).

Null and empty texts are clean. Text without a character outside ASCII never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.codepoints import column, flatten, unflatten

#: Encodings in which UTF-8 bytes were read. Fixed values.
ENCODINGS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
LOST = 0xFFFD
NONE = 999
#: Log probabilities of changing state, per symbol; a run of ASCII is one symbol.
ENTER, LEAVE, STAY, SWITCH = np.log(1e-4), np.log(0.3), np.log(0.7), np.log(1e-6)
#: Share of a character after a class it was never met behind, of its share overall; least probability.
BACKOFF, FLOOR = 1e-5, 1e-11
IMPOSSIBLE = -60.0


def _byte_of(encoding: str) -> np.ndarray:
    """For each code point of the basic plane, its byte in ``encoding``; bytes the encoding leaves
    undefined stand for the control character of the same number."""
    table = np.full(0x10000, NONE, dtype=np.int16)
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        if len(c) == 1:
            table[ord(c)] = b
    table[0] = NONE
    return table


BYTES = [_byte_of(e) for e in ENCODINGS]


#: Single-byte text read in another single-byte encoding, as (true, read) places in ENCODINGS. Latin-1 is
#: no true encoding of its own: its characters have the same bytes in cp1252.
PAIRS = [(t, r) for t in range(len(ENCODINGS)) if ENCODINGS[t] != "latin-1" for r in range(len(ENCODINGS)) if t != r]


def _transcoding(true: int, read: int) -> np.ndarray:
    """For each code point beyond ASCII, the character that its byte in ``read`` is in ``true``; 0 for none."""
    char = np.zeros(256, dtype=np.uint32)
    for b in range(0x80, 256):
        try:
            char[b] = ord(bytes([b]).decode(ENCODINGS[true]))
        except UnicodeDecodeError:
            pass
    byte = BYTES[read]
    return np.where((byte >= 0x80) & (byte < 256), char[np.minimum(byte, 255)], 0).astype(np.uint32)


TRANSCODED = [_transcoding(t, r) for t, r in PAIRS]


def suspicious(text: Column) -> Column:
    """What every text with a garbled or lost character is: not all ASCII. A single wrong letter can be one that
    other texts rightly hold, so only the model can tell."""
    return F.octet_length(text) != F.length(text)


def sequences(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each encoding, where a sequence begins that decodes to one character, its length, and the
    character."""
    after = np.append(flat[1:], 0)
    at = np.flatnonzero((flat >= 0x80) & ((after >= 0x80) | ((flat == 0xC3) & (after == 0x20))))
    near = [np.minimum(np.append(flat, [0] * 3)[at + d], 0xFFFF) for d in range(4)]
    out = []
    for k, table in enumerate(BYTES):
        b0, b1, b2, b3 = (table[x].astype(np.int32) for x in near)
        if k < 2:
            b1 = np.where((near[1] == 0x20) & (b0 == 0xC3), 0xA0, b1)
        t1, t2, t3 = ((b >= 0x80) & (b <= 0xBF) for b in (b1, b2, b3))
        two = (b0 >= 0xC2) & (b0 <= 0xDF) & t1
        three = (b0 >= 0xE0) & (b0 <= 0xEF) & t1 & t2
        four = (b0 >= 0xF0) & (b0 <= 0xF4) & t1 & t2 & t3
        cp = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        n = np.where(two, 2, np.where(three & (cp >= 0x800) & ((cp < 0xD800) | (cp > 0xDFFF)), 3, np.where(four & (cp >= 0x10000) & (cp <= 0x10FFFF), 4, 0)))
        good = n > 0
        out.append((at[good], n[good], cp[good].astype(np.uint32)))
    return out


def _rows_with(flat: np.ndarray, starts: np.ndarray, found: list) -> np.ndarray:
    """Texts that hold a decodable sequence or a lost character."""
    lost = np.flatnonzero((flat == LOST) | ((flat >= 0x80) & (flat < 0xA0)))
    hits = np.concatenate([lost, *(at for at, _, _ in found)])
    out = np.zeros(len(starts), dtype=bool)
    out[np.searchsorted(starts, hits, side="right") - 1] = True
    return out


def _class_table() -> np.ndarray:
    """Classes of the preceding character: 0 none, 1 space, 2 digit, 3 lower and 4 upper Latin,
    5 Cyrillic or Greek, 6 kana and ideographs, 7 ASCII marks, 8 the rest."""
    kind = np.full(0x10000, 8, dtype=np.int8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            kind[c] = 1
        elif c < 0x80:
            kind[c] = 2 if ch.isdigit() else 3 if ch.islower() else 4 if ch.isupper() else 7
        elif 0xC0 <= c < 0x250:
            kind[c] = 3 if ch.islower() else 4 if ch.isupper() else 8
        elif 0x370 <= c < 0x530:
            kind[c] = 5
        elif 0x3040 <= c < 0xA000:
            kind[c] = 6
    kind[0] = 0
    return kind


CLASS = _class_table()


#: Letters of other scripts that pass for Latin ones, and ligatures: found in words without wrong decoding.
LOOK_ALIKE = np.isin(np.arange(0x10000), [ord(c) for c in "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһӏқвкмнтΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικτγηѵԛԝµμβ"] + list(range(0xFB00, 0xFB07)))
UPPER = np.array([chr(c).isupper() for c in range(0x10000)]) & ~LOOK_ALIKE
FOREIGN = np.array([chr(c).isalpha() for c in range(0x10000)]) & (CLASS == 5) & ~LOOK_ALIKE


def misplaced(flat: np.ndarray) -> np.ndarray:
    """Where a capital beyond ASCII follows a small Latin letter, or a Greek or Cyrillic letter stands between
    Latin ones: the traces of single-byte text read in another encoding."""
    at = np.flatnonzero(flat >= 0x80)
    near = np.minimum(flat[at], 0xFFFF)
    before, after = classes(flat[at - 1]), classes(flat[np.minimum(at + 1, len(flat) - 1)])
    latin = ((before == 3) | (before == 4)) & ((after == 3) | (after == 4))
    return at[((before == 3) & UPPER[near]) | (latin & FOREIGN[near])]


def classes(flat: np.ndarray) -> np.ndarray:
    return CLASS[np.minimum(flat, 0xFFFF)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, _ = flatten(column(batch, "text"))
        plain = (flat >= 0xA0) & (flat != LOST)
        for first, n, _ in sequences(flat):
            for d in range(4):
                plain[first[n > d] + d] = False
        plain[misplaced(flat)] = False
        at = np.flatnonzero(plain)
        key = classes(flat[at - 1]).astype(np.int64) << 32 | flat[at]
        values, counts = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["key", "n"])


def clean_counts(texts: DataFrame) -> tuple[dict[int, int], int]:
    """How often each character beyond ASCII follows each class, over all ``texts`` (column ``text``) outside
    decodable sequences and not misplaced, and the number of all characters. The result is bounded by the alphabet."""
    plain = texts.filter(F.col("text").isNotNull() & (F.octet_length("text") != F.length("text")))
    counted = plain.select("text").mapInArrow(_count_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 1
    return {r.key: r.n for r in counted.collect()}, total


class Labeller:
    """Labels the characters of texts; see the module's description."""

    def __init__(self, counts: dict[int, int], total: int):
        chars = sorted({k & 0xFFFFFFFF for k in counts})
        self.chars = np.array(chars or [0x80], dtype=np.uint32)
        place = {c: i for i, c in enumerate(chars)}
        share = np.zeros((9, len(self.chars) + 1))
        for k, n in counts.items():
            share[k >> 32, place[k & 0xFFFFFFFF]] = n / total
        self.score = np.log(share + BACKOFF * share.sum(axis=0) + FLOOR)

    def clean(self, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        at, known = self._place(cp)
        return np.where(cp < 0x80, -4.0, self.score[before, np.where(known, at, len(self.chars))])

    def decoded(self, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The same for a decoded character: one that the corpus doesn't know can only be the trace of a
        second decoding."""
        trace = (cp < 0x10000) & (BYTES[0][np.minimum(cp, 0xFFFF)] != NONE)
        return np.where(self._place(cp)[1] | trace, self.clean(before, cp), IMPOSSIBLE)

    def gains(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the characters beyond ASCII, and which of the distinct contexts each is in; of each context
        the clean emission, and what each of PAIRS (rows) gains there: the emission of the transcoded character,
        behind the transcoded one before it, less the clean."""
        at = np.flatnonzero(flat >= 0x80)
        own, last = np.minimum(flat[at], 0xFFFF).astype(np.int64), np.minimum(flat[at - 1], 0xFFFF).astype(np.int64)
        key = np.where(last < 0x80, CLASS[last], last) << 16 | own
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        cps, own, last = flat[at[first]], own[first], last[first]
        lost = (cps == LOST) | ((cps >= 0x80) & (cps < 0xA0))
        clean = np.where(lost, IMPOSSIBLE, self.clean(CLASS[last], cps))
        out = np.full((len(PAIRS), len(first)), IMPOSSIBLE)
        for k, table in enumerate(TRANSCODED):
            cp, prior = table[own], table[last]
            place, known = self._place(cp)
            before = CLASS[np.where(prior > 0, prior, last)]
            out[k] = np.where(known & (cp > 0), self.score[before, np.where(known, place, 0)], IMPOSSIBLE)
        return at, of, clean, out - clean

    def _place(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.chars, cp)
        return at, (at < len(self.chars)) & (self.chars[np.minimum(at, len(self.chars) - 1)] == cp)

    def label(self, texts: list[str]) -> tuple[list[bool], list[str]]:
        """Whether each text holds wrongly decoded characters, and its restored form. A text is restored until
        nothing changes; a form that it already had (two single-byte pairs can undo each other) ends it too."""
        garbled = np.zeros(len(texts), dtype=bool)
        out = list(texts)
        had: list[set[str]] = [set() for _ in texts]
        todo = np.arange(len(texts))
        while len(todo):
            found, restored = self._once([out[i] for i in todo])
            garbled[todo] |= found
            changed = []
            for i, new in zip(todo.tolist(), restored):
                had[i].add(out[i])
                if new not in had[i]:
                    out[i] = new
                    changed.append(i)
            todo = np.array(changed, dtype=np.int64)
        return garbled.tolist(), out

    def _once(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        flat, starts = flatten(texts)
        found_at = sequences(flat)
        at, context, clean, gain = self.gains(flat)
        better = np.flatnonzero((gain > 0).any(axis=0)[context])
        holder = np.searchsorted(starts, at[better], side="right") - 1
        # A single-byte pair that cannot gain what it costs to enter and leave its state is in no best path.
        most = np.array([np.bincount(holder, weights=np.maximum(g, 0)[context[better]], minlength=len(texts)) for g in gain])
        enough = most > -(ENTER + LEAVE)
        active = np.flatnonzero(enough.any(axis=1))
        some = np.flatnonzero(_rows_with(flat, starts, found_at) | enough.any(axis=0))
        if len(some) < len(texts):
            found, out = np.zeros(len(texts), dtype=bool), list(texts)
            if len(some):
                found[some], fixed = self._once([texts[i] for i in some.tolist()])
                for i, x in zip(some.tolist(), fixed):
                    out[i] = x
            return found, out
        size, before = len(flat), np.concatenate(([0], classes(flat)[:-1]))
        ends = np.concatenate((starts[1:] - 1, [size - 1]))
        high = flat >= 0x80
        # One symbol per character beyond ASCII and per run of ASCII.
        first = high | (flat == 0) | np.concatenate(([True], high[:-1] | (flat[:-1] == 0)))
        symbol = np.flatnonzero(first & (flat != 0))
        row = np.searchsorted(starts, symbol, side="right") - 1
        single = 1 + len(ENCODINGS)
        states = single + len(active) + 1
        emit = np.zeros((len(symbol), states), dtype=np.float32)
        special = high[symbol]
        lost = (flat == LOST) | ((flat >= 0x80) & (flat < 0xA0))
        emit[:, 0] = np.where(special, np.where(lost[symbol], IMPOSSIBLE, self.clean(before[symbol], flat[symbol])), 0)
        inside = np.zeros(emit.shape, dtype=bool)  # within a sequence: a state can't begin there
        of = np.full(size + 4, -1, dtype=np.int64)  # the symbol of each position
        of[symbol] = np.arange(len(symbol))
        for k, (begin, n, cp) in enumerate(found_at):
            emit[special, 1 + k] = IMPOSSIBLE
            for d in (1, 2, 3):
                inner = of[begin[n > d] + d]
                inner = inner[inner >= 0]
                emit[inner, 1 + k], inside[inner, 1 + k] = 0, True
            emit[of[begin], 1 + k], inside[of[begin], 1 + k] = self.decoded(before[begin], cp), False
        for k, pair in enumerate(active):
            emit[of[at], single + k] = (clean + gain[pair])[context]
        emit[:, -1] = np.where(special, np.where(lost[symbol], -3.0, IMPOSSIBLE), 0)
        state = self._viterbi(emit, inside, row, len(texts))
        found = np.zeros(len(texts), dtype=bool)
        found[row[special & (state > 0)]] = True
        keep, new = np.ones(size, dtype=bool), flat.copy()
        for k, pair in enumerate(active):
            mine = at[state[of[at]] == single + k]
            cp = TRANSCODED[pair][np.minimum(flat[mine], 0xFFFF)]
            new[mine] = np.where(cp > 0, cp, flat[mine])
        for k, (begin, n, cp) in enumerate(found_at):
            mine = state[of[begin]] == 1 + k
            new[begin[mine]] = cp[mine]
            for d in (1, 2, 3):
                keep[begin[mine & (n > d)] + d] = False
        moved = np.concatenate(([0], np.cumsum(keep)))
        return found, unflatten(new[keep], moved[starts], moved[ends])

    @staticmethod
    def _viterbi(emit: np.ndarray, inside: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The best state of each symbol. Texts of similar length go together, one step for all. A state other
        than clean is reached from itself, from clean, or from the best of all others at one price."""
        states = emit.shape[1]
        own = np.arange(states, dtype=np.int8)
        enter, leave, stay, switch, barred = (np.float32(x) for x in (ENTER, LEAVE, STAY, SWITCH, 10 * IMPOSSIBLE))
        begin = np.searchsorted(row, np.arange(rows))
        sizes = np.searchsorted(row, np.arange(rows), side="right") - begin
        out = np.zeros(len(row), dtype=np.int8)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < rows:
            group = order[at : at + 256]
            while len(group) > 1 and len(group) * int(sizes[group[-1]]) > 400_000:
                group = group[: len(group) // 2]
            at += len(group)
            steps = int(sizes[group[-1]])
            if not steps:
                continue
            where = begin[group][:, None] + np.arange(steps)
            valid = np.arange(steps) < sizes[group][:, None]
            e = np.where(valid[..., None], emit[np.where(valid, where, 0)], 0)
            score = e[:, 0] + np.where(own == 0, np.float32(0), enter)
            back = np.zeros((steps, len(group), states), dtype=np.int8)
            for t in range(1, steps):
                other = (1 + score[:, 1:].argmax(axis=1)).astype(np.int8)
                best, clean = score[np.arange(len(group)), other], score[:, 0]
                fresh = np.where(clean + enter >= best + switch, np.int8(0), other)[:, None]
                price = np.maximum(clean + enter, best + switch)[:, None] + inside[where[:, t] * valid[:, t]] * barred
                through = score + stay
                back[t] = np.where(price >= through, fresh, own)
                through = np.maximum(price, through)
                back[t, :, 0] = np.where(clean >= best + leave, np.int8(0), other)
                through[:, 0] = np.maximum(clean, best + leave)
                score = np.where(valid[:, t, None], through + e[:, t], score)
            state = score.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                live = valid[:, t]
                out[where[live, t]] = state[live]
                if t:
                    state = np.where(live, back[t][np.arange(len(group)), state], state)
        return out


def garbled_texts(df: DataFrame, keys: list[str], model: tuple[dict[int, int], int] | None = None) -> DataFrame:
    """Rows of ``df`` (``keys`` and ``text``) with wrongly decoded characters: keys, ``restored``.

    What cannot be restored (lost characters) stays as it is. Repeated rows stay repeated.
    """
    counts, total = model or clean_counts(df)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(counts, total)
        for batch in batches:
            found, restored = labeller.label(column(batch, "text"))
            kept = batch.append_column("restored", pa.array(restored, pa.string())).filter(pa.array(found, pa.bool_()))
            yield kept.select([*keys, "restored"])

    picked = df.filter(F.col("text").isNotNull() & suspicious(F.col("text"))).select(*keys, "text")
    return picked.mapInArrow(run, f"{schema}, restored string")


def restored_texts(df: DataFrame, key: str) -> DataFrame:
    """Every row of ``df`` (unique ``key``, ``text``) with ``text`` restored where it was garbled."""
    fixed = garbled_texts(df, [key]).select(F.col(key).alias("fixed key"), F.col("restored").alias("fixed text"))
    joined = df.join(fixed, df[key] == fixed["fixed key"], "left")
    return joined.select(*[F.coalesce(fixed["fixed text"], df["text"]).alias("text") if c == "text" else df[c] for c in df.columns])
