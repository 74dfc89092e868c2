from collections import defaultdict
import random
import re

from quillspark.llm import repeated_lines as R

SCHEMA = "page_key string, document_id string, text string"


def brute(rows):
    fold = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    pages = {k: (d, t) for k, d, t in rows if t and t.strip()}
    on, size = defaultdict(set), defaultdict(int)
    for k, (d, t) in pages.items():
        size[d] += 1
        for line in t.split("\n"):
            if re.search(r"[^\W\d_]", line):
                on[d, fold(line)].add(k)
    return {(k, i + 1) for k, (d, t) in pages.items() for i, line in enumerate(t.split("\n")) if len(p := on.get((d, fold(line)), ())) >= 5 and len(p) * 5 >= size[d]}


def made(seed=1, pages=120):
    rng = random.Random(seed)
    rows = []
    for d in ("hot", "small", "tiny"):
        for i in range({"hot": pages, "small": 12, "tiny": 3}[d]):
            lines = [f"text {rng.random()} of {d} page" for _ in range(4)] + ["", "- 12 -"]
            if rng.random() < 0.4:
                lines.append(rng.choice(["All  rights reserved", "ALL RIGHTS RESERVED"]))
            if rng.random() < 0.21:
                lines.append(f"Printed on day {i}")
            rng.shuffle(lines)
            rows.append((f"{d}__p{i}", d, "\n".join(lines)))
    return rows + rows[:7] + [("x__p1", "x", None), ("x__p2", "x", ""), ("x__p3", None, "a line")]


def test_equals_brute_force(spark):
    rows = made()
    got = {(r.page_key, r.line_no) for r in R.repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert got == brute(rows) and got


def test_removal(spark):
    rows = made(2)
    found = brute(rows)
    clean = {r.page_key: r.text for r in R.clean_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(clean) == len({k for k, _, _ in rows})
    for k, _, t in rows:
        if t:
            assert clean[k] == "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (k, i) not in found)


def test_summary_keeps_its_bound():
    rng = random.Random(3)
    s, true = R.Summary(), defaultdict(int)
    for _ in range(5000):
        lines = {rng.randrange(10**9) for _ in range(6)} | ({1} if rng.random() < 0.25 else set()) | ({2} if rng.random() < 0.2 else set())
        for x in lines:
            true[x] += 1
        s.add(list(lines))
    assert s.lost * R.ERROR < s.pages and len(s.counters) < 5000
    assert all(true[x] - s.lost <= s.counters[x] <= true[x] for x in (1, 2))


def test_empty_table(spark):
    assert R.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_hash_is_not_enough(spark, monkeypatch):
    rows = [(f"p{i}", "d", f"the same line\nline {'abcdefgh'[i]} of its own") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(R, "candidates", lambda pages, sizes: R.F.broadcast(spark.createDataFrame([("d",)], "document_id string")).join(pages.select(R.F.explode(R.F.split("text", "\n")).alias("x")).select(R.F.xxhash64(R.folded_line(R.F.col("x"))).alias("line_hash")).distinct()))
    assert {r.line_no for r in R.repeated_lines(df).collect()} == {1}


def test_folded_line(spark):
    rows = [("  Page\t 12 of  340 ", "page 0 of 0"), ("Größe\u00a07", "größe 0"), ("", "")]
    for raw, want in rows:
        assert spark.createDataFrame([(raw,)], "x string").select(R.folded_line(R.F.col("x")).alias("y")).first().y == want


def test_large_sets_and_early_summaries(spark, monkeypatch):
    rows = made(4)
    df = spark.createDataFrame(rows, SCHEMA)
    few = {r.page_key: r.text for r in R.clean_pages(df).collect()}
    monkeypatch.setattr(R, "is_small", lambda df: False)
    monkeypatch.setattr(R, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(R, "HELD", 50)
    assert {r.page_key: r.text for r in R.clean_pages(df).collect()} == few
