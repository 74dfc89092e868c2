"""Order-dependent columns and chunkers: equal to plain windows, and to a walk over the pages."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import ordered as O
from quillspark.operators import sections as S


def rows(spark):
    data = [(g, n, f"{g}{n}", None if n % 7 else f"v{n}") for g in ("a", "b") for n in range(1, 300 if g == "a" else 3)]
    return spark.createDataFrame(data, "g string, n int, id string, v string")


def test_blocks_equal_windows(spark):
    df = O.blocked(rows(spark), "n", 16)
    w = W.partitionBy("g").orderBy("n")
    want = df.select("id", F.row_number().over(w).alias("seq"), F.last("v", ignorenulls=True).over(w).alias("last"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))
    got = O.numbered(df, "g", ["n"])
    got = O.carried(got, "g", ["n"], F.col("v"), "last")
    got = O.beside(got, "g", ["n"], F.col("id"), "prev", True)
    got = O.beside(got, "g", ["n"], F.col("id"), "next", False)
    assert sorted(map(tuple, got.select("id", "seq", "last", "prev", "next").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    sums = O.summed(df, ["g"], ["n"], F.col("n"), "before").select("id", "before").collect()
    assert {r.id: r.before for r in sums} == {r.id: sum(range(1, int(r.id[1:]))) for r in sums}


def pages(spark, texts):
    return spark.createDataFrame([("D", i + 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")


def test_sections_are_carried_five_pages(spark):
    body = "some text that goes on."
    got = [(r.section, r.section_source) for r in S.carried_sections(pages(spark, ["Open surgery\n" + body] + [body] * 7)).orderBy("page_number").collect()]
    assert got[0] == ("Open surgery", "detected") and got[5] == ("Open surgery", "inherited") and got[6] == (None, "unknown")


SENTENCE = "Surveillance of small aneurysms is advised every 12 months in adults with 4.0 - 4.4 cm and others. "


def count(text):
    return len(S.word_spans(text))


def test_short_texts_stay_whole():
    assert S.split_text(SENTENCE) == [SENTENCE.strip()]
    assert S.split_text("") == S.split_text(None) == S.split_text(" \n ") == []


def test_pieces_fit_end_safely_and_overlap():
    text = " ".join(SENTENCE.replace("12", str(n)).strip() for n in range(40))
    pieces = S.split_text(text)
    assert len(pieces) > 2 and all(count(p) <= S.BUDGET for p in pieces) and all(p.endswith(".") for p in pieces)
    at = 0
    for p in pieces:  # in order, without a gap
        here = text.index(p, max(0, at - 600))
        assert here <= at or not text[at:here].strip()
        at = here + len(p)
    assert at == len(text)
    runs = lambda p: {" ".join(p.split()[i : i + 8]) for i in range(len(p.split()) - 7)}
    assert all(len(runs(a) & runs(b)) / len(runs(a) | runs(b)) < 0.75 for a, b in zip(pieces, pieces[1:]))
    assert all(set(a.split()[-12:]) & set(b.split()[:40]) for a, b in zip(pieces, pieces[1:]))


def test_text_without_a_safe_point_ends():
    pieces = S.split_text("aneurysm " * 2000)
    assert all(count(p) <= S.BUDGET for p in pieces) and sum(map(count, pieces)) >= 2000


@pytest.mark.parametrize("text", ["from 5.5 cm on", "65 - 75 years", "65-\n75 years", "0.98-\n1.00"])
def test_numbers_are_never_cut(text):
    a, b = next((m.start(), m.end()) for m in S.NUMBER.finditer(text))
    assert not [p for p in S.safe_points(text) if a < p < b]


def test_a_sliver_joins_the_piece_before():
    text = "One two three four five six seven eight nine ten. " * 30 + "The end."
    pieces = S.split_text(text, budget=110, shared=0, limit=200, least=16)
    assert pieces[-1].endswith("The end.") and count(pieces[-1]) >= 16


def test_long_spans_come_in_parts(spark):
    lines = [f"line {i} of a very long recommendation about surveillance of the aorta in adults" for i in range(900)]
    text = ["Recommendation 7", *lines]
    df = pages(spark, ["\n".join(text[i : i + 30]) for i in range(0, len(text), 30)])
    parts = S.spans(df).orderBy("part").collect()
    assert len(parts) > 5 and all(len(p.text) < S.PRECUT + 200 and p.kind == "recommendation" and p.label == "7" for p in parts)
    assert "\n".join(p.text for p in parts) == "\n".join(text)
    chunks = S.atomic_chunks(df).collect()
    assert all(count(c.text) <= S.LIMIT for c in chunks)
    assert {m for c in chunks for m in re.findall(r"line \d+ ", c.text)} == {f"line {i} " for i in range(900)}


def walk(rows):
    """Buffers by a walk over the pages of one document: (page, first page of its buffer)."""
    out, held, section = [], [], None

    def flush():
        out.extend((p, held[0][0]) for p, _ in held)
        held.clear()

    for page, chars, alone, own in rows:
        if alone:
            flush()
            out.append((page, page))
            section = own
            continue
        if held and own != section:
            flush()
        section = own
        if held and sum(n for _, n in held) + 2 * len(held) + chars > S.MOST_CHARS:
            flush()
        held.append((page, chars))
        if sum(n for _, n in held) + 2 * (len(held) - 1) >= S.ENOUGH_CHARS:
            flush()
    flush()
    return sorted(out)


def test_buffers_equal_a_walk_over_the_pages(spark):
    rng = random.Random(3)
    data = []
    for d, n, kinds in (("A", 400, [150, 200, 300, 880]), ("B", 90, [121, 899, 2000, 50]), ("C", 1, [10]), ("D", 200, [120])):
        section = None
        for p in range(1, n + 1):
            if d == "B" and rng.random() < 0.2 or d == "A" and rng.random() < 0.004:
                section = rng.choice(["x", "y", None])
            chars = rng.choice(kinds)
            data.append((d, p, chars, chars < 120, section))
    got = S.buffers(spark.createDataFrame(data, "document_id string, page_number int, chars int, alone boolean, section string")).collect()
    for d in "ABCD":
        assert sorted((r.page_number, r.first) for r in got if r.document_id == d) == walk([x[1:] for x in data if x[0] == d]), d


def test_strategies(spark):
    df = pages(spark, ["x " * 100])
    assert S.chunked(df).count() == 1
    with pytest.raises(ValueError):
        S.chunked(df, "other")


def test_recommendation_is_not_cut_by_a_page(spark):
    long = "words of the recommendation that go on and on until they end here. "
    got = S.atomic_chunks(pages(spark, [long, "Recommendation 4\n" + long, long + "\n3 Surveillance of the aorta\n" + long, None])).orderBy("seq").collect()
    assert [(r.kind, r.page_start, r.page_end) for r in got] == [("page", 1, 1), ("recommendation", 2, 3), ("section", 3, 3)]
    assert [r.chunk_id for r in got][1] == "D__p2-3__c0002"


def test_page_buffer(spark):
    df = pages(spark, ["a " * 80, "b " * 80, None, "c " * 80, "d" * 90, "e " * 10, "f " * 80]).withColumn("section", F.when(F.col("page_number") < 3, "x").otherwise("y")).withColumn("status", F.when(F.col("page_number") == 7, "corrupted").otherwise("ok"))
    got = S.page_buffer_chunks(df).orderBy("seq").collect()
    assert [(r.page_start, r.page_end, r.section) for r in got] == [(1, 2, "x"), (4, 4, "y"), (5, 5, "y")]
    assert S.atomic_chunks(pages(spark, [None])).count() == 0
    assert S.page_buffer_chunks(df.limit(0)).count() == 0


@pytest.mark.parametrize("line,kind", [
    ("Recommendation 11", "recommendation"), ("1.5.4 Offer aspirin", "recommendation"), ("3.3 Screening for AAA", "section"), ("5 Management", "section"), ("3 Svensjo S, Bjorck M, Gurtel", None), ("4.2 Diagnosis ........ 12", None),
    ("2 Results were mixed. Others agree", None), ("7 Trials; and cohorts", None), ("12 A heading ends in a colon:", None), ("plain text", None), ("Recommendation 1111", None), ("", None), ("9 One two three four five six seven eight nine ten eleven twelve thirteen", None),
])
def test_anchors_of_lines(spark, line, kind):
    assert spark.range(1).select(S.anchored(F.lit(line))["kind"].alias("k")).first().k == kind


def test_percentiles_equal_sorting(spark):
    rng = random.Random(4)
    data = [(g, None if rng.random() < 0.1 else round(rng.choice([rng.random() * 10, rng.gauss(0, 1), 5.0]), 3)) for g in ("a", "b", None) for _ in range(200)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = {r.g: (r.p25, r.p95) for r in O.percentiles(spark.createDataFrame(data, "g string, v double"), "g", "v", {"p25": 0.25, "p95": 0.95}, blocks=16).collect()}

    def at(values, p):
        place = (len(values) - 1) * p
        low = int(place)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)

    for g in ("a", "b", "one", "same"):
        values = sorted(v for x, v in data if x == g and v is not None)
        assert got[g] == pytest.approx((at(values, 0.25), at(values, 0.95)))
    assert "none" not in got
