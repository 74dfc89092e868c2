"""Section state over the pages of a document, and the two chunkers.

A document of any length is spread over tasks. Section state, anchors and running lengths carry one summary per block of
pages (see ``ordered``); lines are cut into spans by expressions, a span's text is brought together in parts of about
``PRECUT`` characters, and pages are packed by their lengths alone, block by block, with where the first buffer of a block
begins carried from one to the next. A document without text gives no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ordered import PAGES_PER_BLOCK, beside, blocked, carried, numbered, summed

# Pages for which a heading is carried on; tokens of a piece, of a recommendation's piece, shared and least;
# characters at which a span is cut beforehand, a buffer is full or may not grow beyond, and below which a page stands alone
# or a span is dropped.
CARRIED, BUDGET, LIMIT, SHARED, LEAST_TOKENS = 5, 220, 510, 40, 16
PRECUT, ENOUGH_CHARS, MOST_CHARS, ALONE_CHARS, LEAST_CHARS = 8000, 900, 2400, 120, 50
# Lines that begin a recommendation or a section, and what such a section line must not hold.
RECOMMENDATION_LINE = r"^\s*Recommendation\s+(\d{1,3})\s*$"
RECOMMENDATION_ID = r"^\s*(\d{1,2}\.\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\s+\S"
SECTION_LINE = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+([A-Z][^\n]{4,90})$"
NOT_A_SECTION = r"\.{4,}|(?:\.[ \t]){4,}|(?i:\bet al\b|doi:|\bAvailable at:|\[Accessed\b|\b\d{4};\s*\d+)"
NOT_A_TITLE = r",.*,|;|\b[A-Z][a-z]+\s+[A-Z]{1,3}[,.]|\.\s+[A-Z]|[,;:]\s*$"
# Where a text may be cut, and numbers with range and unit inside which it may not.
CUT = re.compile(r"\n\s*\n|(?<=[.!?])\s+(?=[A-Z0-9])|\n")
NUMBER = re.compile(r"\d+(?:[.,]\d+)?(?:\s*[–\-]\s*\d+(?:[.,]\d+)?)?(?:\s*(?:%|cm|mm|years?))?", re.I)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: At most so many pages fit into a buffer, for each has ALONE_CHARS at least.
PAGES_IN_BUFFER = -(-ENOUGH_CHARS // ALONE_CHARS)


def page_heading(text: Column) -> Column:
    """The first line of a page if it reads like a heading, else null."""
    first = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    shaped = first.rlike(r"^[A-Z]") & ~first.rlike(r"[.,;:?!-]$") & (F.length(first) <= 45) & (F.size(F.split(first, " ")) <= 6)
    return F.when(shaped, first)


def carried_sections(pages: DataFrame, pages_back: int = CARRIED) -> DataFrame:
    """``pages`` (document_id, page_number, text, unique per document and page) with ``section`` and
    ``section_source``: the heading on the page (detected), the last one up to ``pages_back`` pages back
    (inherited), or null (unknown)."""
    own = blocked(pages, "page_number").withColumn("own", page_heading(F.col("text")))
    value = F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("title"), F.col("page_number").alias("page")))
    out = carried(own, "document_id", ["page_number"], value, "last")
    near = F.col("page_number") - F.col("last.page") <= pages_back
    source = F.when(F.col("own").isNotNull(), "detected").when(near, "inherited").otherwise("unknown")
    return out.select("document_id", "page_number", "text", F.when(near, F.col("last.title")).alias("section"), source.alias("section_source"))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Tokens of a text as (begin, end): words and marks. Any other tokenizer's spans may take their place."""
    return [m.span() for m in TOKEN.finditer(text)]


def safe_points(text: str) -> list[int]:
    """Places where a text may be cut: after blank lines, sentences and lines, never inside a number with its range and
    unit; its two ends."""
    points = {0, len(text), *(m.end() for m in CUT.finditer(text)), *(m.end() for m in re.finditer("\n", text))}
    numbers = [m.span() for m in NUMBER.finditer(text)]
    begins = [a for a, _ in numbers]

    def free(p: int) -> bool:
        i = bisect_left(begins, p) - 1
        return i < 0 or p >= numbers[i][1]

    return sorted(p for p in points if free(p))


def split_text(text: str | None, budget: int = BUDGET, shared: int = SHARED, limit: int = LIMIT, least: int = LEAST_TOKENS, spans: Callable[[str], list[tuple[int, int]]] = word_spans) -> list[str]:
    """Pieces of a text. Within ``limit`` tokens it stays whole. Otherwise every piece ends at the last safe point within
    ``budget`` tokens and the next begins up to ``shared`` tokens (half the piece at most) before, at a safe point if there
    is one; where no safe point fits, the rest is cut by tokens. A last piece below ``least`` joins the one before."""
    text = (text or "").strip()
    tokens = spans(text)
    if len(tokens) <= limit:
        return [text] if text else []
    shared = max(0, min(shared, budget - 1))
    points, begins = safe_points(text), [a for a, _ in tokens]
    pieces: list[tuple[int, int]] = []
    start = done = 0
    while start < len(text):
        first = bisect_left(begins, start)
        if len(tokens) - first <= budget:
            pieces.append((start, len(text)))
            break
        end = points[bisect_right(points, begins[first + budget]) - 1]
        if end <= start:  # no safe point fits
            for at in range(first, len(tokens), max(1, budget - shared)):
                stop = min(at + budget, len(tokens))
                pieces.append((begins[at], tokens[stop - 1][1]))
                if stop == len(tokens):
                    break
            break
        if end <= done:  # all up to here is in a piece
            start = done
            continue
        pieces.append((start, end))
        done, last = end, bisect_left(begins, end)
        back = min(shared, (last - first) // 2)
        wish = max(start + 1, begins[last - back]) if back else end
        snapped = points[bisect_right(points, wish) - 1]
        start = snapped if start < snapped else wish
    out = [x for a, b in pieces if (x := text[a:b].strip())]
    if len(out) > 1 and len(spans(out[-1])) < least and len(spans(out[-2] + "\n" + out[-1])) <= limit:
        out[-2:] = [out[-2] + "\n" + out[-1]]
    return out


def anchored(line: Column) -> Column:
    """The anchor that a line is: struct of kind (recommendation, section) and label, or null."""
    number, title = F.regexp_extract(line, SECTION_LINE, 1), F.trim(F.regexp_extract(line, SECTION_LINE, 2))
    section = line.rlike(SECTION_LINE) & ~line.rlike(NOT_A_SECTION) & ~title.rlike(NOT_A_TITLE) & (F.size(F.split(title, r"\s+")) <= 12)
    kind = lambda k, label: F.struct(F.lit(k).alias("kind"), label.alias("label"))
    return (
        F.when(line.rlike(RECOMMENDATION_LINE), kind("recommendation", F.regexp_extract(line, RECOMMENDATION_LINE, 1)))
        .when(line.rlike(RECOMMENDATION_ID), kind("recommendation", F.regexp_extract(line, RECOMMENDATION_ID, 1)))
        .when(section, kind("section", F.concat_ws(" ", number, title)))
    )


def spans(pages: DataFrame, precut: int = PRECUT) -> DataFrame:
    """``pages`` (document_id, page_number, text) cut at anchors, and at page breaks unless a recommendation goes on:
    document_id, page_start, page_end, line_no, part, kind, label, section (the enclosing one), text. Spans beyond
    ``precut`` characters come in parts of about that size, cut between lines."""
    rows = blocked(pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text"), "page_number")
    order = ["page_number", "line_no"]
    lines = rows.select("document_id", "page_number", "block", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("anchor", anchored(F.col("line")))
    own = F.struct("page_number", "line_no", "anchor.kind", "anchor.label")
    lines = carried(lines, "document_id", order, F.when(F.col("anchor").isNotNull(), F.col("anchor.kind")), "hard")
    lines = carried(lines, "document_id", order, F.when(F.col("anchor.kind") == "section", F.col("anchor.label")), "section")
    page = F.struct("page_number", "line_no", F.lit("page").alias("kind"), F.lit("").alias("label"))
    begins = F.when(F.col("anchor").isNotNull(), own).when((F.col("line_no") == 0) & (F.coalesce("hard", F.lit("")) != "recommendation"), page)
    lines = carried(lines, "document_id", order, begins, "of")
    lines = lines.select("document_id", "block", *order, "line", "section", F.col("of.page_number").alias("page_start"), F.col("of.line_no").alias("first"), "of.kind", "of.label")
    lines = summed(lines, ["document_id", "page_start", "first"], order, F.length("line") + 1, "before").withColumn("part", F.floor(F.col("before") / precut).cast("int"))
    whole = lines.groupBy("document_id", "page_start", "first", "part").agg(F.min("page_number").alias("from"), F.max("page_number").alias("page_end"), F.any_value("kind").alias("kind"), F.any_value("label").alias("label"), F.min_by("section", F.struct(*order)).alias("section"), F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("lines"))
    text = F.regexp_replace(F.array_join("lines.line", "\n"), r"^\s+|\s+$", "")
    out = whole.select("document_id", F.when(F.col("part") == 0, F.col("page_start")).otherwise(F.col("from")).alias("page_start"), "page_end", F.col("first").alias("line_no"), "part", "kind", "label", "section", text.alias("text"))
    return out.filter((F.length("text") >= LEAST_CHARS) | ((F.col("part") > 0) & (F.length("text") > 0)))


def _pieces(found: DataFrame, budget: int, limit: int, shared: int) -> DataFrame:
    """Spans as numbered chunks; a recommendation's pieces may fill the ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = [limit if k == "recommendation" else min(budget, limit) for k in pdf["kind"]]
            pdf["text"] = [split_text(t, b, shared, limit) for t, b in zip(pdf["text"], size)]
            pdf["piece"] = [list(range(len(x))) for x in pdf["text"]]
            yield pdf.explode(["text", "piece"]).dropna(subset=["text"])

    rows = found.select("document_id", "page_start", "page_end", "line_no", "part", "kind", "label", "section", F.lit(0).alias("piece"), "text")
    out = rows.mapInPandas(run, rows.schema)
    out = numbered(blocked(out, "page_start"), "document_id", ["page_start", "line_no", "part", "piece"])
    name = F.format_string("%s__p%d-%d__c%04d", "document_id", "page_start", "page_end", "seq")
    return out.select("document_id", name.alias("chunk_id"), "kind", "label", "section", "page_start", "page_end", "seq", "text")


def atomic_chunks(pages: DataFrame, budget: int = BUDGET, limit: int = LIMIT, shared: int = SHARED) -> DataFrame:
    """Chunks of ``pages`` (document_id, page_number, text) along recommendations, headings and pages."""
    return _pieces(spans(pages), budget, limit, shared)


def _next(lengths: list[int], at: int) -> int:
    """Where the buffer after the one that begins at ``at`` begins."""
    total = 0
    for i in range(at, len(lengths)):
        if total and total + 2 + lengths[i] > MOST_CHARS:
            return i
        total += lengths[i] + (2 if total else 0)
        if total >= ENOUGH_CHARS:
            return i + 1
    return len(lengths)


def buffers(pages: DataFrame) -> DataFrame:
    """``pages`` (document_id, page_number, chars, alone, section) with ``first``: the page that begins the buffer each is
    in. Pages that stand alone are their own. A buffer ends where the section changes, before it would hold more than
    ``MOST_CHARS``, and once it holds ``ENOUGH_CHARS``; lengths alone are looked at."""
    order = ["page_number"]
    rows = blocked(pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "chars", "alone", "section"), "page_number")
    ends = F.struct((F.col("alone") | (F.col("chars") >= ENOUGH_CHARS)).alias("ends"), F.col("section").alias("section"))
    rows = beside(rows, "document_id", order, ends, "before", back=True)
    fresh = F.col("before").isNull() | F.col("before.ends") | F.col("alone") | ~F.col("before.section").eqNullSafe(F.col("section"))
    rows = summed(rows, ["document_id"], order, F.when(fresh, 1).otherwise(0), "runs").withColumn("run", F.col("runs") + F.when(fresh, 1).otherwise(0))
    alone = rows.filter("alone").select("document_id", "page_number", F.col("page_number").alias("first"))
    rows = summed(rows.filter("NOT alone"), ["document_id", "run"], order, F.lit(1), "place")
    size = PAGES_PER_BLOCK
    rows = rows.select("document_id", "run", "page_number", "chars", F.col("place").cast("int").alias("place"))
    # Every block also has the first pages of the next, into which its last buffer may reach.
    also = F.when((F.col("place") >= size) & (F.col("place") % size < PAGES_IN_BUFFER), F.array(F.floor(F.col("place") / size), F.floor(F.col("place") / size) - 1)).otherwise(F.array(F.floor(F.col("place") / size)))
    blocks = rows.withColumn("block", F.explode(also)).groupBy("document_id", "run", "block").agg(F.array_sort(F.collect_list(F.struct("place", "page_number", "chars"))).alias("pages"))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each page on which the first buffer of a block may begin, where that of the next block does."""
        for pdf in batches:
            out = []
            for lengths in pdf["lengths"]:
                own, row = min(size, len(lengths)), []
                for entry in range(PAGES_IN_BUFFER + 1):
                    at = entry
                    while at < own:
                        at = _next(list(lengths), at)
                    row.append(max(0, at - size))
                out.append(row)
            pdf["exits"] = out
            yield pdf[["document_id", "run", "block", "exits"]]

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, numbers, lengths, entry in zip(pdf["document_id"], pdf["numbers"], pdf["lengths"], pdf["entry"]):
                at, own = int(entry), min(size, len(lengths))
                while at < own:
                    stop = _next(list(lengths), at)
                    out += [(d, int(p), int(numbers[at])) for p in numbers[at:stop]]
                    at = stop
            yield pd.DataFrame(out, columns=["document_id", "page_number", "first"])

    flat = blocks.select("document_id", "run", "block", F.col("pages.page_number").alias("numbers"), F.col("pages.chars").alias("lengths"))
    found = flat.select("document_id", "run", "block", "lengths").mapInPandas(exits, "document_id string, run long, block long, exits array<int>")
    chain = found.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("b"))
    entries = F.aggregate("b", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(x["exits"], F.element_at(acc, -1)))))
    entry = chain.select("document_id", "run", F.posexplode(F.slice(entries, 1, F.size("b"))).alias("block", "entry")).withColumn("block", F.col("block").cast("long"))
    packed = flat.join(entry, ["document_id", "run", "block"]).select("document_id", "numbers", "lengths", "entry").mapInPandas(starts, "document_id string, page_number int, first int")
    return packed.unionByName(alone)


def page_buffer_chunks(pages: DataFrame, budget: int = BUDGET, limit: int = LIMIT, shared: int = SHARED) -> DataFrame:
    """Chunks of consecutive pages of one section packed into buffers; ``pages`` (document_id, page_number, text, section,
    status). Corrupted pages are left out, pages with little text stand alone, buffers with hardly any give no chunk."""
    text = F.coalesce("text", F.lit(""))
    rows = pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), text.alias("text"), "section", (F.col("status") == "corrupted").alias("bad"), ((F.col("status") == "low_text") | (F.length(text) < ALONE_CHARS)).alias("low"))
    sized = rows.select("document_id", "page_number", F.length("text").alias("chars"), F.coalesce(F.col("bad") | F.col("low"), F.col("low"), F.lit(False)).alias("alone"), "section")
    good = rows.filter(~F.coalesce("bad", F.lit(False))).join(buffers(sized), ["document_id", "page_number"])
    whole = good.groupBy("document_id", "first").agg(F.max("page_number").alias("page_end"), F.min_by("section", "page_number").alias("section"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("texts"))
    joined = F.array_join(F.filter("texts.text", lambda x: F.length(F.trim(x)) > 0), "\n\n")
    out = whole.select("document_id", F.col("first").alias("page_start"), "page_end", F.lit(0).alias("line_no"), F.lit(0).alias("part"), F.lit("page").alias("kind"), F.lit("").alias("label"), "section", F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text"))
    return _pieces(out.filter(F.length("text") >= LEAST_CHARS), budget, limit, shared)


STRATEGIES = {"atomic": atomic_chunks, "page_buffer": page_buffer_chunks}


def chunked(pages: DataFrame, strategy: str = "atomic", **sizes: int) -> DataFrame:
    """Chunks by the strategy of that name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](pages, **sizes)
