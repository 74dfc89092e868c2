"""Problem 2: one consistent form for texts that look the same.

Arrow text becomes one flat array of code points per batch; every step is a gather through a lookup
table or a shift of that array, never a call per row:

1. drop what has no width (kept between letters of scripts whose shape it decides, and in emoji), and
   the carriage return of a line end;
2. spaces of any kind become U+0020, hyphens of any kind U+002D; wide, narrow, contextual and ligature
   forms become their ordinary letters; raised and lowered figures, fractions, quotation marks, dashes
   and letter case stay, for a reader can tell them apart;
3. composed letters are taken apart;
4. look-alike letters: a word with a letter that only Cyrillic (Greek) has is written in that script
   throughout, a word with a letter that only Latin has in Latin letters. A Latin word with foreign
   look-alikes, and a foreign word with Latin ones, thus each get one form. A word in letters that the
   scripts share follows the script that most of its text's other words show, Latin where they tie;
5. marks are put into canonical order and composed (normal form C).

Null stays null, empty text empty. ASCII text without carriage returns never leaves the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.llm.codepoints import Expansions, expand, flatten_arrow, unflatten_arrow

# Characters without width, spaces, hyphens, and the letters that look alike.
ZERO_WIDTH = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
SPACES = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovcj"
FOLDED = {"wide", "narrow", "noBreak", "initial", "medial", "final", "isolated"}

PAIR = np.uint64(21)
#: No character beyond this one decomposes, composes or is folded.
LAST = 0x30000


def _folds() -> dict[int, tuple[int, ...]]:
    """Expansion of every character that is written another way but looks ordinary."""
    out: dict[int, tuple[int, ...]] = {}
    for c in range(0x80, LAST):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        ligature = 0xFB00 <= c <= 0xFB4F or c in (0x132, 0x133, 0x13F, 0x140, 0x149, 0xB5) or 0x1C4 <= c <= 0x1CC or 0x1F1 <= c <= 0x1F3
        if kind.strip("<>") in FOLDED and kind.startswith("<") or (kind == "<compat>" and ligature):
            full = unicodedata.normalize("NFKC", chr(c))
            if not any(unicodedata.combining(x) for x in full[:1]):
                out[c] = tuple(map(ord, full))
    out |= {ord(c): (0x20,) for c in SPACES} | {ord(c): (0x2D,) for c in HYPHENS} | {ord(c): () for c in ZERO_WIDTH}
    return out | {c: () for c in range(0xFE00, 0xFE10)}


@cache
def tables() -> dict:
    """Lookup tables, built once per Python worker from the Unicode data of the interpreter."""
    apart: dict[int, tuple[int, ...]] = {}
    pairs: dict[int, int] = {}
    ccc = np.zeros(sys.maxunicode + 2, dtype=np.uint8)
    letter = np.zeros(0x10000, dtype=bool)
    for c in range(LAST):
        ch = chr(c)
        if (k := unicodedata.combining(ch)):
            ccc[c] = k
        if c < 0x10000 and c < 0xD800:
            letter[c] = ch.isalpha()
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<"):
            apart[c] = tuple(map(ord, unicodedata.normalize("NFD", ch)))
            two = [int(x, 16) for x in d.split()]
            if len(two) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[two[0] << 21 | two[1]] = c
    keys = np.array(sorted(pairs), dtype=np.uint64)
    second = np.zeros(sys.maxunicode + 2, dtype=bool)
    second[(keys & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
    second[0x1161:0x1176] = second[0x11A8:0x11C3] = True
    # Letters that look alike: 1 Cyrillic, 2 Greek; the letters that only such a script has: 3, 4.
    script = np.zeros(0x10000, dtype=np.int8)
    for c in range(0x370, 0x530):
        if letter[c]:
            script[c] = 4 if c < 0x400 else 3
    latin = np.arange(0x10000, dtype=np.uint32)
    to = {1: np.arange(0x10000, dtype=np.uint32), 2: np.arange(0x10000, dtype=np.uint32)}
    for kind, own, like in ((1, CYRILLIC, CYRILLIC_AS_LATIN), (2, GREEK, GREEK_AS_LATIN)):
        for a, b in zip(own, like):
            script[ord(a)], latin[ord(a)] = kind, ord(b)
            to[kind][ord(b)] = ord(a)
    folds = _folds()
    touched = np.zeros(LAST + 1, dtype=bool)
    touched[list(folds)] = touched[0] = True
    touched[np.flatnonzero(script)] = True
    touched[: LAST] |= (ccc[:LAST] > 0) | second[:LAST]
    touched[[c for c in apart if unicodedata.normalize("NFC", chr(c)) != chr(c)]] = True
    touched[0] = False
    shared = np.zeros(0x10000, dtype=bool)
    shared[[ord(x) for x in CYRILLIC_AS_LATIN + GREEK_AS_LATIN]] = True
    latin_letter = letter & (np.arange(0x10000) < 0x250)
    word = letter.copy()
    word[ord("0") : ord("9") + 1] = True
    return {"touched": touched, "folds": Expansions(folds), "apart": Expansions(apart), "keys": keys, "values": np.array([pairs[int(k)] for k in keys], dtype=np.uint32), "ccc": ccc, "second": second, "script": script, "latin": latin, "to": to, "word": word, "shared": shared, "latin letter": latin_letter}


def _composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The character that ``a`` and ``b`` compose to; 0 for none."""
    t = tables()
    key = a.astype(np.uint64) << PAIR | b.astype(np.uint64)
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    out = np.where(t["keys"][at] == key, t["values"][at], 0)
    x, y = a.astype(np.int64), b.astype(np.int64)
    lv = (x >= 0x1100) & (x < 0x1113) & (y >= 0x1161) & (y < 0x1176)
    lvt = (x >= 0xAC00) & (x < 0xD7A4) & ((x - 0xAC00) % 28 == 0) & (y > 0x11A7) & (y < 0x11C3)
    return np.where(lv, 0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28, np.where(lvt, x + y - 0x11A7, out)).astype(np.uint32)


def compose(flat: np.ndarray) -> np.ndarray:
    """Normal form C of a flat array, all texts at once."""
    return _together(expand(flat, tables()["apart"]))


def _together(flat: np.ndarray) -> np.ndarray:
    """Compose a flat array that was taken apart."""
    t = tables()
    top = len(t["ccc"]) - 1
    merged = True
    while merged:
        ccc = t["ccc"][np.minimum(flat, top)].astype(np.int64)
        flat = _with_marks(flat, ccc) if ccc.any() else flat
        merged = False
        while True:  # neighbours that compose though neither is a mark
            low = np.minimum(flat, top)
            at = np.flatnonzero(t["second"][low] & (t["ccc"][low] == 0))
            at = at[at > 0]
            made = _composed(flat[at - 1], flat[at])
            at, made = at[made > 0], made[made > 0]
            if not len(at):
                break
            merged = True
            first = np.concatenate(([True], np.diff(at) > 1))
            flat = flat.copy()
            flat[at[first] - 1] = made[first]
            flat = np.delete(flat, at[first])
    return flat


def _with_marks(flat: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Put the marks of each letter into canonical order and compose those that do."""
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        order = np.lexsort((ccc, np.cumsum(ccc == 0)))  # stable; a letter has class 0 and stays before its marks
        flat, ccc = flat[order], ccc[order]
    flat = flat.copy()
    keep = np.ones(len(flat), dtype=bool)
    marks = np.flatnonzero(ccc)
    first = np.concatenate(([True], np.diff(marks) > 1))
    heads = marks[first] - 1
    sizes = np.diff(np.concatenate((np.flatnonzero(first), [len(marks)]))) + 1
    live, last = np.arange(len(heads)), np.zeros(len(heads), dtype=np.int64)
    step = 1
    while len(live):  # the step-th mark of every letter that has one
        head, mark = heads[live], heads[live] + step
        made = np.where(last[live] < ccc[mark], _composed(flat[head], flat[mark]), 0)
        flat[head] = np.where(made > 0, made, flat[head])
        keep[mark] = made == 0
        last[live] = np.where(made > 0, last[live], ccc[mark])
        step += 1
        live = live[sizes[live] > step]
    return flat[keep]


def _fold(flat: np.ndarray) -> np.ndarray:
    t = tables()
    shaped = np.concatenate(([0], flat[:-1])).astype(np.int64)
    joins = ((shaped >= 0x600) & (shaped < 0xE00)) | (shaped >= 0x1F000)
    joiner = ((flat == 0x200C) | (flat == 0x200D) | ((flat >= 0xFE00) & (flat < 0xFE10))) & joins
    held = np.where(joiner, np.uint32(0x10FFFE), flat)
    held = held[~((held == 0x0D) & (np.concatenate((held[1:], [0])) == 0x0A))]
    out = expand(held, t["folds"])
    if joiner.any():
        out[out == 0x10FFFE] = 0x200D
    return out


def _one_script(flat: np.ndarray, by_text: bool) -> np.ndarray:
    t = tables()
    low = np.minimum(flat, 0xFFFF)
    script = t["script"][low]
    if not script.any():
        return flat
    inside = t["word"][low] | (t["ccc"][np.minimum(flat, len(t["ccc"]) - 1)] > 0)
    start = inside & ~np.concatenate(([False], inside[:-1]))
    word = np.where(inside, np.cumsum(start), 0)
    n = int(word.max()) + 1
    own = {k: np.bincount(word[script == k], minlength=n) > 0 for k in (3, 4)}
    kind = np.where(own[3], 3, np.where(own[4], 4, 0))
    kind[0] = 0
    if by_text:  # words in shared letters only follow the script that most words of their text show
        latin_only = np.bincount(word[(script == 0) & (t["shared"][low] == 0) & t["latin letter"][low]], minlength=n) > 0
        text = np.cumsum(flat == 0)
        of = np.zeros(n, dtype=np.int64)
        of[word[start]] = text[start]
        rows = int(text.max()) + 1
        votes = {k: np.bincount(of[1:][(kind == k)[1:]], minlength=rows) for k in (3, 4)}
        latin = np.bincount(of[1:][(latin_only & (kind == 0))[1:]], minlength=rows)
        most = np.where(votes[3] > np.maximum(latin, votes[4]), 3, np.where(votes[4] > np.maximum(latin, votes[3]), 4, 0))
        kind = np.where((kind == 0) & ~latin_only, most[of], kind)
        kind[0] = 0
    cyrillic, greek = kind[word] == 3, kind[word] == 4
    return np.where(cyrillic, t["to"][1][t["latin"][low]], np.where(greek, t["to"][2][t["latin"][low]], np.where(low == flat, t["latin"][low], flat))).astype(np.uint32)


def _form(flat: np.ndarray, by_text: bool) -> np.ndarray:
    return _together(_one_script(expand(_fold(flat), tables()["apart"]), by_text))


def _touched(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts with a character that some step touches."""
    touched = tables()["touched"][np.minimum(flat, LAST)] | ((flat == 0x0D) & (np.append(flat[1:], 0) == 0x0A))
    return np.unique(np.searchsorted(starts, np.flatnonzero(touched), side="right") - 1)


def canonical_arrow(texts: pa.Array, by_text: bool = True) -> pa.Array:
    """The consistent form of each text of an Arrow array; null stays null. Texts without a character that any step
    touches are not converted."""
    flat, starts = flatten_arrow(texts)
    rows = _touched(flat, starts)
    if not len(rows):
        return texts
    flat, _ = flatten_arrow(texts.take(pa.array(rows)))
    place = np.full(len(texts), -1, dtype=np.int64)
    place[rows] = np.arange(len(rows))
    changed = unflatten_arrow(_form(flat, by_text)).cast(texts.type)
    return pa.concat_arrays([texts, changed]).take(pa.array(np.where(place >= 0, len(texts) + place, np.arange(len(texts)))))


def canonical_list(texts: list[str], by_text: bool = True) -> list[str]:
    """The same for a list of texts."""
    return canonical_arrow(pa.array(texts, pa.large_string()), by_text).to_pylist()


@F.arrow_udf(StringType())
def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield canonical_arrow(texts)


def canonical_text(text: Column) -> Column:
    """The consistent form of a text column; only texts that may change go to Python."""
    foreign = F.when((F.octet_length(text) != F.length(text)) | text.contains("\r"), text)
    return F.coalesce(_canonical(foreign), text)


def same_looking(df: DataFrame) -> DataFrame:
    """``df`` (table_name, record_key, text; repeated deliveries allowed) as one row per record: digests
    of the stored text and of its consistent form. Null texts are left out."""
    rows = df.filter(F.col("text").isNotNull()).withColumn("form", canonical_text(F.col("text")))
    return rows.select("table_name", "record_key", F.md5("text").alias("stored"), F.md5("form").alias("form")).groupBy("table_name", "record_key").agg(F.max_by(F.struct("stored", "form"), "stored").alias("x")).select("table_name", "record_key", "x.stored", "x.form")


def look_alike_pairs(members: DataFrame) -> DataFrame:
    """Pairs of records that look the same and are stored differently, smaller key first.

    Pairs are first made of stored variants of one form, then each side is expanded to its records, so exact
    copies, however many, never meet each other. All joins are by digest, which adaptive execution splits.
    """
    variants = members.select("table_name", "form", "stored").distinct()
    other = variants.select("table_name", "form", F.col("stored").alias("second"))
    differ = variants.withColumnRenamed("stored", "first").join(other, ["table_name", "form"]).filter("first < second").drop("form")
    a = members.select("table_name", F.col("stored").alias("first"), F.col("record_key").alias("a"))
    b = members.select("table_name", F.col("stored").alias("second"), F.col("record_key").alias("b"))
    pairs = differ.join(a, ["table_name", "first"]).join(b, ["table_name", "second"])
    return pairs.select("table_name", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def classes(members: DataFrame) -> DataFrame:
    """Records of which some other looks the same and is stored differently, one row each: table_name, record_key, class_id
    (digest of the form they share), records and stored variants of the class."""
    sizes = members.groupBy("table_name", "form").agg(F.count("*").alias("records"), F.count_distinct("stored").alias("variants")).filter("variants > 1")
    return members.join(sizes, ["table_name", "form"]).select("table_name", "record_key", F.col("form").alias("class_id"), "records", "variants")
