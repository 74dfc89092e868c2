"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import parsing, text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,section,kind", [
    ("Diagnosis......... 6 Treatment......... 9", None, "toc"),
    ("Contents . . . . . . . . . . . . 4", None, "toc"),
    ("_ " * 100, None, "boilerplate"),
    ("", None, "boilerplate"),
    (None, None, "boilerplate"),
    ("A et al. 2001 doi: 1 B et al. 2002 doi: 2 C et al. doi: 3", None, "reference"),
    ("Abdominal aortic disease", None, "title_only"),
    ("We recommend screening at 55 mm. Grade A", "REFERENCES", "clinical"),
])
def test_content_type(spark, text, section, kind):
    row = spark.createDataFrame([(text, section)], "t string, s string").select(T.content_type(F.col("t"), F.col("s")).alias("k")).first()
    assert row.k == kind


@pytest.mark.parametrize("value", [None, "nan", "None", "", " NULL ", "n/a", "<NA>"])
def test_missing_values(spark, value):
    assert one(spark, value, T.present) is None


def test_present_values_stay(spark):
    assert one(spark, "A", T.present) == "A"
    assert one(spark, "0", T.present) == "0"


def test_extraction_status(spark):
    assert one(spark, None, T.extraction_status) == "image_only"
    assert one(spark, "short", T.extraction_status) == "low_text"
    assert one(spark, "�" * 30 + "x" * 100, T.extraction_status) == "corrupted"
    assert one(spark, "a | b | c\n" * 20, T.extraction_status) == "ok"
    assert one(spark, "#" * 200, T.extraction_status) == "corrupted"


def test_compared_form(spark):
    assert one(spark, "  Eﬃcient “care”\n ≥ 5–6 ", T.compared) == 'efficient "care" 5 6'


def test_tokens(spark):
    assert one(spark, "The 5.5 cm aneurysm isn’t small", T.lexical_tokens) == ["the", "5.5", "cm", "aneurysm", "isn't", "small"]
    assert one(spark, "the repair of the aorta", T.content_tokens) == ["repair", "aorta"]


@pytest.mark.parametrize("text,stance", [
    ("Surgery is not recommended", "negative"), ("Repair should be offered", "positive"), ("The sky is blue", None),
    ("must never be offered", "negative"), ("offer repair, but not in winter", "positive"), ("avoid smoking", "negative"), ("", None),
])
def test_polarity(spark, text, stance):
    assert one(spark, text, lambda c: T.polarity(T.matched(c))) == stance


def test_numbers(spark):
    assert one(spark, "≥ 5.5 cm, 65–75 years", T.numeric_tokens) == [">=5.5cm", "65-75years"]


def test_slug_and_estimate(spark):
    assert one(spark, " A-b/c! ", T.slug) == "A_b_c"
    assert one(spark, "x" * 35, T.token_estimate) == 266


@pytest.mark.parametrize("text,found", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('<think>{"b": 2}</think>{"a": "}"}', '{"a": "}"}'), ("none", None), (None, None), ('{bad} {"a": {"b": 1}}', '{"a": {"b": 1}}'), ("<think>{", None),
])
def test_first_object(text, found):
    assert parsing.first_object(text) == found


def test_json_objects_by_either_way(spark):
    texts = ['```json\n{"a": 1}\n```', '<think>{"b": 2}</think>{"a": 1}', 'x {bad} {"a": 1} y', "none", None, '<think>{', '{"a": 1} and {"c": 2}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", F.from_json(parsing.json_object(F.col("x")), "a int")["a"].alias("a")).collect()
    assert {r.i: r.a for r in rows} == {0: 1, 1: 1, 2: 1, 3: None, 4: None, 5: None, 6: 1}


def test_name_id(spark):
    import uuid

    for name in ("DOC__p1-1__c0001", "", "é"):
        assert one(spark, name, parsing.name_id) == str(uuid.uuid5(parsing.NAMESPACE, name))


@pytest.mark.parametrize("text,want", [
    ("CTA-based", "cta-based"), ("CTA–based", "cta-based"), ("CTA—based", "cta-based"), ("CTA−based", "cta-based"), ("well‐known", "well-known"), ("well‑known", "well-known"), ("55‒5.5", "55-5.5"), ("A―B", "a-b"), ("A－B", "a-b"),
    ("‘don’t", "'don't"), ("“word”", '"word"'), ("„Wort“", '"wort"'), ("`word`", "'word'"), ("´word´", "'word'"), ("a\xa0b", "a b"), ("a\u2009\u200bb", "a b"), ("\ufeffx", "x"), ("ｗｉｄｅ　１２", "wide 12"), ("eﬃcient ﬅ", "efficient st"),
    ("30 e 39 mm", "30-39 mm"), ("a ≥ 5", "a 5"), ("m²", "m2"), ("e\u0301tat", "état"), ("…", "..."), (" A\t\nB ", "a b"), ("", ""), (None, None),
])
def test_matched_form(spark, text, want):
    assert one(spark, text, T.matched) == want


@pytest.mark.parametrize("text,want", [
    ("55 mm", {("mm", 55.0)}), ("5.5 cm", {("mm", 55.0)}), ("every three years", {("month", 36.0)}), ("annually", {("month", 12.0)}), ("aneurysms 40–49 mm", {("mm", 40.0), ("mm", 49.0)}), ("Recommendation 13", set()),
    ("twelve weeks", {("week", 12.0)}), ("half-yearly", {("month", 6.0), ("month", 12.0)}), ("every six months", {("month", 6.0)}), ("2 g and 500 mg", {("mg", 2000.0), ("mg", 500.0)}), ("5 millimetres", {("mm", 5.0)}), ("", set()),
])
def test_quantities(spark, text, want):
    rows = spark.createDataFrame([(text,)], "x string").select(F.inline(T.quantities(T.matched(F.col("x"))))).collect()
    assert {tuple(r) for r in rows} == want


def test_stems(spark):
    words = {"recommendations": "recommend", "recommendation": "recommend", "statements": "stat", "management": "manag", "strikingly": "strik", "reportedly": "report", "screening": "screen", "therapies": "therap", "carried": "carr", "repaired": "repair", "outcomes": "outcom", "directly": "direct", "risks": "risk", "used": "used"}
    for word, want in words.items():
        assert one(spark, word, T.stem) == want == T.stem_of(word)


def test_novel_stems(spark):
    chunk = "Elective repair should be considered for men at a maximum diameter of 55 mm or larger."

    def novel(claim):
        tokens = lambda c: T.content_tokens(T.matched(F.lit(c)))
        return spark.range(1).select(T.novel_stems(tokens(claim), tokens(chunk)).alias("x")).first().x

    assert novel("The guideline explicitly recommends surveillance above that threshold.") == []
    assert novel("Repair is considered for men once the aneurysm reaches 55 mm.") == ["reach"]
    assert len(novel("Metformin infusion reverses aneurysm expansion in diabetic men.")) >= 2
    assert len(novel("Elective repair also requires lifelong dual antiplatelet therapy.")) >= 2


def test_loose_match(spark):
    rows = [("Management of AAA, 2024", "management of aaa", True), ("NVGC_2024", "NVGC_2024", True), ("", "x", False), (None, "x", False), ("a", "b", False)]
    for a, b, want in rows:
        assert spark.range(1).select(T.matches_loosely(T.matched(F.lit(a)), T.matched(F.lit(b))).alias("x")).first().x is want
