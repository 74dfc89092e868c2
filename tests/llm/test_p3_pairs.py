import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import pairs as P

Q = "When should older adults with an aneurysm be referred for surgical repair?"
TEXTS = {
    "en": "The guideline recommends that patients with large aneurysms are referred for repair when the risk is acceptable and the team agrees. ",
    "de": "Die Leitlinie empfiehlt, dass Betroffene mit großem Aneurysma überwiesen werden, wenn das Risiko vertretbar ist und das Team zustimmt. ",
    "fr": "Le guide recommande que les patients avec un grand anévrisme soient adressés pour une réparation lorsque le risque est acceptable. ",
}


@pytest.mark.parametrize("answer,empty", [(None, True), ("", True), ("  ​", True), ("N/A", True), ("nan", True), ("[]", True), ("...", True), ("\\n\\n", True), ("No.", False), ("Nan et al.", False)])
def test_empty(spark, answer, empty):
    assert spark.createDataFrame([(answer,)], "a string").select(P.is_empty(F.col("a")).alias("x")).first().x is empty


@pytest.mark.parametrize("answer,cut", [
    ("A whole sentence.", False), ("It ends [NVGC_2024, p. 3]", True), ("It ends. [NVGC_2024, p. 3]", False), ("It ends. [NVGC_20", True), ("As stated (Class I, Level A)", False), ("It breaks off at the", True),
    ("Options:\n- one thing\n- other things", False), ("1. One.\n2. Two.\n3. Thr", True), ("He said “stop.”", False), ("a value of 5,", True), ("これは文です。", False), ("Done!\n", False), ("the wishes (n =", True),
])
def test_truncated(spark, answer, cut):
    assert spark.createDataFrame([(answer,)], "a string").select(P.is_truncated(F.col("a")).alias("x")).first().x is cut


@pytest.mark.parametrize("answer,copy", [(Q, True), (Q.upper(), True), ("**" + Q[:-1] + "**", True), ("Question: " + Q, True), (Q + " " + TEXTS["en"], False), (TEXTS["en"], False), (None, False), ("When should older adults with aneurysm be referred for surgical repair", True)])
def test_copy(spark, answer, copy):
    assert spark.createDataFrame([(Q, answer)], "q string, a string").select(P.is_copy(F.col("q"), F.col("a")).alias("x")).first().x is copy


def results(spark):
    rows, i = [], 0

    def add(query, answer, refusal=None, confidence="High", again=False):
        nonlocal i
        i += 1
        rows.append((i, query, answer, refusal, confidence, 1))
        if again:
            rows.append((i, query, answer, refusal, confidence, 2))
        return i

    topics = ["statin treatment", "open repair", "duplex follow-up", "smoking cessation", "blood pressure control", "geriatric review"]
    want = {}
    for k, t in enumerate(topics):
        q = f"What does the guideline state about {t} in adults aged {k}0 years?"
        want[add(q, f"We cannot process questions on {t} at the moment.", "no_chunks_retrieved" if k % 2 else "nan", again=k == 0)] = "refusal"
        want[add(q, f"Sorry, {t} isn't something I'm able to assess.", None, "Insufficient Evidence" if k % 2 else "Low")] = "refusal"
        add(q, f"The guideline makes no recommendation on {t} in adults, and the panel asks for a trial of patients.")
        add(q, TEXTS["en"] * 2)
        want[add(q, TEXTS["de"])] = "wrong_language"
        want[add(q, (TEXTS["en"] * 2)[:-12])] = "truncated"
    want[add("Was empfiehlt die Leitlinie für Betroffene mit großem Aneurysma?", TEXTS["en"])] = "wrong_language"
    add("Was empfiehlt die Leitlinie für Betroffene mit großem Aneurysma?", TEXTS["de"])
    want[add(None, None)] = "empty"
    want[add(Q, Q, "None")] = "copies_question"
    return rows, want


def test_defects(spark):
    rows, want = results(spark)
    df = spark.createDataFrame(rows, "result_id long, query string, answer string, refusal string, confidence string, ingested_at int").withColumn("opening", F.lit("x"))
    docs = spark.createDataFrame([(i, lang, t * 4, len(t) * 4) for i, (lang, t) in enumerate(TEXTS.items())], "doc_id long, lang string, text string, n_chars long")
    got = {r.result_id: r.defect for r in P.defects(df, docs).collect()}
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "result_id long, query string, answer string, refusal string, confidence string, ingested_at int")
    docs = spark.createDataFrame([], "doc_id long, lang string, text string, n_chars long")
    assert P.defects(df, docs).count() == 0


NAMES = ["alder", "birch", "cedar", "ebony", "ficus", "hazel", "larch", "maple", "olive", "poplar", "rowan", "willow"]
DECLINED = "{a} wishes to thank everyone for this thoughtful message about {b}. The present system holds no passage from which a safe reply could be drawn, and guessing would serve nobody, so the matter must rest here until further material has been added by those who maintain it, which usually happens every few weeks when new editions of the printed volumes are released to the public by their several authors."


def long_templates(spark):
    rows = [(i, f"Question on {x}ology and {y}graphy?", DECLINED.format(a=x.title(), b=y), "no_chunks_retrieved" if i % 4 == 0 else None, "Low") for i, (x, y) in enumerate(zip(NAMES, reversed(NAMES)))]
    return spark.createDataFrame(rows, "result_id long, query string, answer string, refusal string, confidence string").withColumn("coded", F.col("refusal").isNotNull())


def test_varied_long_templates_are_found_by_their_links(spark, monkeypatch):
    pairs = long_templates(spark)
    assert {r.result_id for r in P.refusals(pairs).collect()} == set(range(12))
    monkeypatch.setattr(P, "links", lambda nodes: nodes.select("node", F.col("node").alias("other")).filter("false"))
    assert P.refusals(pairs).count() == 0


def test_coded_once_or_for_one_prompt_is_no_template(spark):
    pairs = long_templates(spark)
    assert P.refusals(pairs.filter("result_id = 0")).count() == 0
    assert P.refusals(pairs.withColumn("query", F.lit("Question on alderology?"))).count() == 0
    shuffled = F.when(F.col("result_id") % 2 == 0, "Question on alderology and willowgraphy?").otherwise("On alderology and willowgraphy: question?")
    assert P.refusals(pairs.withColumn("query", shuffled)).count() == 0


def test_links_join_what_is_similar(spark):
    rng = random.Random(5)
    letters = [f"w{i}" for i in range(40)]
    texts = set()
    for _ in range(12):
        base = [rng.choice(letters) for _ in range(60)]
        for _ in range(12):
            new = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.choice([0, 1, 58, 59, rng.randrange(60)])
                new[k] = rng.choice(letters)
            texts.add(" ".join(new[: rng.choice([60, 60, 59, 56])]))
    texts = sorted(texts)
    runs = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets = [runs(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(top(i), set()).add(t)
    found = spark.createDataFrame([(t.split(),) for t in texts * 2], "opening array<string>")
    text = {r.n: " ".join(r.opening) for r in found.select("opening", P.node_of(F.col("opening")).alias("n")).collect()}
    got = {}
    for r in P.clusters(found).collect():
        got.setdefault(r.cluster, set()).add(text[r.node])
    # Bands may miss a single link, of which a component has many; none is invented.
    assert all(any(g <= w for w in want.values()) for g in got.values())
    assert len(got) <= len(want) * 1.1 and len(want) < len(texts) / 3
