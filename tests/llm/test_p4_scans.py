import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import scans as S

SENTENCES = [
    "the surveillance interval depends on the diameter of the aneurysm and the general condition of patients",
    "before surgical repair the department documents cardiac function and discusses alternatives with relatives",
    "protocol-driven treatment improved satisfaction among low-risk adults without complications during admission",
    "nurse-led management reduced readmission although the certainty of this particular finding remains moderate",
    "randomised comparison between endovascular reconstruction and conservative management showed considerable benefit",
]


def corpus(spark, pages=60):
    rng = random.Random(4)
    return spark.createDataFrame([(" ".join(rng.choice(SENTENCES).capitalize() + "." for _ in range(12)),) for _ in range(pages)], "text string")


def scanned(spark):
    rng = random.Random(8)
    words = sorted({w for x in SENTENCES for w in x.replace("-", " ").split()})
    fill = lambda: [" ".join(rng.sample(words, 7)) for _ in range(3)]
    rows, want = [], set()
    for p in range(1, 13):
        key = f"D__p{p}"
        own = ["The surveillance interval depends on the dia-", "meter of the aneurysm and the gcneral condition.", "In low-", "risk adults the certainty remains moderate", "in 5O patients of the department."]
        lines = ["Care pathway for" if p % 2 else "MIDLAND BOARD", *fill(), *own, *fill(), f"- {p} -"]
        want |= {(key, 1, "running_header"), (key, 5, "hyphen_break"), (key, 6, "misread"), (key, 9, "misread"), (key, 13, "page_number")}
        rows.append((key, "D", "Care pathway for adults", p, "\n".join(lines)))
    rows += rows[:2] + [("E__p1", "E", None, 1, None), ("E__p2", "E", "x", 2, " \n ")]
    return spark.createDataFrame(rows, "page_key string, document_id string, document_name string, page_number int, text string"), want


def test_noise(spark):
    pages, want = scanned(spark)
    got = {tuple(r) for r in S.noise(pages, corpus(spark)).collect()}
    assert got == want


def test_repair(spark):
    pages, _ = scanned(spark)
    text = {r.page_key: r.text for r in S.repaired(pages, corpus(spark)).collect()}["D__p3"]
    assert "on the diameter of the aneurysm and the general condition." in text
    assert "In low-risk adults" in text and "50 patients" in text
    assert "Care pathway" not in text and "- 3 -" not in text


def test_candidates_within_two_edits_are_complete(spark):
    rng = random.Random(2)
    alphabet = "abcde"
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(150)}
    known = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    asked = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in asked for b in words if a != b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= (2 if len(a) > 3 else 1)}
    got = {(r.word, r.candidate) for r in S.candidates(spark.createDataFrame([(w,) for w in asked], "word string"), known).collect()}
    assert want - got == set()


def test_very_long_words_are_known_and_corrected(spark):
    long = "rinderkennzeichnungsfleischetikettierungsueberwachungsaufgabenuebertragung"
    known = spark.createDataFrame([(long, 9), ("surveillance", 9)], "word string, n long")
    asked = spark.createDataFrame([(long.replace("flei", "fiei"),)], "word string")
    assert [r.candidate for r in S.candidates(asked, known).collect()] == [long]
    counts = S.word_counts(spark.createDataFrame([(long,)], "text string"))
    assert [r.word for r in counts.collect()] == [long]


def test_repaired_text_is_the_true_one(spark):
    """Pages printed with line breaks, cut words, misread letters and furniture come out as they were."""
    rng = random.Random(6)
    vocabulary = sorted({w for x in SENTENCES for w in x.split()})
    rows, true = [], {}
    for p in range(1, 31):
        words = " ".join(" ".join(rng.sample(vocabulary, 11)).capitalize() + "." for _ in range(8)).split()
        true[f"D__p{p}"] = " ".join(words)
        lines, line = [], []
        for w in words:
            if len(line) >= 8:
                if rng.random() < 0.3 and len(w) > 7 and "-" not in w:
                    lines.append(" ".join([*line, w[:4] + "-"]))
                    line = [w[4:]]
                    continue
                lines.append(" ".join(line))
                line = []
            if rng.random() < 0.04 and "e" in w and len(w) > 6 and "-" not in w:
                w = w.replace("e", "c", 1)
            line.append(w)
        lines.append(" ".join(line))
        rows.append((f"D__p{p}", "D", "Care pathway for adults", p, "\n".join(["Care pathway for adults", *lines, f"Page {p}"])))
    pages = spark.createDataFrame(rows, "page_key string, document_id string, document_name string, page_number int, text string")
    got = {r.page_key: r.text for r in S.repaired(pages, corpus(spark)).collect()}
    right = total = 0
    for k, want in true.items():
        a, b = got[k].split(), want.split()
        total += len(b)
        right += sum(x == y for x, y in zip(a, b)) if len(a) == len(b) else sum((Counter(a) & Counter(b)).values())
    assert right >= 0.99 * total


def test_page_numbers_need_an_edge_and_a_match(spark):
    rows = [(f"D__p{p}", "D", "Name", p, f"First words of the page are here.\nMore words\n84\nand more words.\nEven more words\nstill more words\nlast words here.\n{p + 10}") for p in range(1, 6)]
    df = spark.createDataFrame(rows, "page_key string, document_id string, document_name string, page_number int, text string")
    got = {(r.line_no, r.noise) for r in S.furniture(S.scanned_lines(df)).filter("noise = 'page_number'").collect()}
    assert got == {(8, "page_number")}


def test_no_scanned_pages(spark):
    pages, _ = scanned(spark)
    assert S.noise(pages.filter("false"), corpus(spark, 3)).count() == 0


def test_sample_of_equal_rows_keeps_both_labels(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE_LINES", 40)
    rows = [(i, f, y) for i, (f, y) in enumerate([(1, 1)] * 90 + [(1, 0)] * 10 + [(0, 0)] * 90 + [(0, 1)] * 10)]
    df = spark.createDataFrame(rows, "id long, f int, y int")
    chance = S._trained(df, [F.col("f")], F.col("y"), -1.0, ["id"])
    got = {r.f: r.p for r in df.select("f", chance.alias("p")).distinct().collect()}
    assert got[0] < 0.5 < got[1] < 1


def test_words_in_capitals_are_joined(spark):
    counts = spark.createDataFrame([(w.strip("."), 20) for w in sorted({w for x in SENTENCES for w in x.split()})], "word string, n long")
    rows = [("p", 1, "THE SURVEIL-", "LANCE INTERVAL"), ("p", 2, "USE OF PROTOCOL-", "DRIVEN CARE"), ("p", 3, "the sur-", "Veillance")]
    lines = spark.createDataFrame(rows, "page_key string, line_no long, line string, after string")
    got = {(r.head, r.tail): r.joined for r in S.joins(lines, counts).collect()}
    assert got == {("SURVEIL", "LANCE"): True, ("PROTOCOL", "DRIVEN"): False}
