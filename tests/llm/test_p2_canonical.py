import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import canonical as C
from quillspark.llm.codepoints import flatten, unflatten


def composed(texts):
    flat, _ = flatten(texts)
    out = C.compose(flat)
    b = np.flatnonzero(out == 0)
    return unflatten(out, b[:-1] + 1, b[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FFFF, exclude_categories=("Cs",)), max_size=12), min_size=1, max_size=4))
def test_composition_is_nfc(texts):
    assert composed(texts) == [unicodedata.normalize("NFC", x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeọ̧́̈éöấ가각क़"), max_size=12))
def test_marks(text):
    assert composed([text]) == [unicodedata.normalize("NFC", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_idempotent(texts):
    once = C.canonical_list(texts)
    assert C.canonical_list(once) == once


def test_same_looks_are_equal():
    same = [
        ("surgісаl", "surgical"), ("ｇｒｏｗｔｈ　２", "growth 2"), ("état", "état"), ("ﬁrst‑degree", "first-degree"), ("w​o⁠r­d", "word"),
        ("a b c d", "a b c d"), ("frа́gil", "frágil"), ("funciόn", "función"), ("µmol", "μmol"), ("a\r\nb", "a\nb"), ("Моskva", "Moskva"), ("пoсле", "после"),
    ]
    for a, b in same:
        assert C.canonical_list([a]) == C.canonical_list([b]), (a, b)


def test_visible_differences_stay():
    for a, b in [("m²", "m2"), ("é", "e"), ("A", "a"), ("a–b", "a-b"), ("’", "'"), ("a  b", "a b"), ("a\nb", "a b"), ("½", "1/2"), ("№", "No"), ("0", "O"), ("наш", "haш")]:
        assert C.canonical_list([a]) != C.canonical_list([b]), (a, b)


def test_shared_letters_follow_their_text():
    russian = "он пришёл со старой собакой, а она рада"
    assert C.canonical_list([russian]) == [russian]
    assert C.canonical_list([russian.replace("со ", "co ")]) == [russian]
    assert C.canonical_list(["а word со shared letters"]) == ["a word co shared letters"]
    assert C.canonical_list([russian], by_text=False) != [russian]


def test_arrow_with_nulls_offsets_and_separators():
    texts = pa.array(["x", None, "état", "", "a\0b", "wоrd", "😀 ﬁn"]).slice(1)
    assert C.canonical_arrow(texts).to_pylist() == [None, "état", "", "a\0b", "word", "😀 fin"]
    assert C.canonical_arrow(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark):
    rows = [("chunks", "a", "word"), ("chunks", "b", "wоrd"), ("chunks", "c", "word"), ("chunks", "a", "word"), ("chunks", "d", None), ("chunks", "e", "other"), ("pages_df", "f", "w​ord"), ("chunks", "g", ""), ("chunks", "h", "​"), ("pages_df", "i", "wörd"), ("pages_df", "j", "wörd")]
    df = spark.createDataFrame(rows, "table_name string, record_key string, text string")
    got = sorted(map(tuple, C.look_alike_pairs(C.same_looking(df)).collect()))
    assert got == [("chunks", "a", "b"), ("chunks", "b", "c"), ("chunks", "g", "h"), ("pages_df", "i", "j")]


def test_column_keeps_nulls_and_length(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 100_000 + "а",)], "t string")
    got = [r.t for r in df.select(C.canonical_text(F.col("t")).alias("t")).collect()]
    assert got == [None, "", "x" * 100_000 + "a"]


def test_many_copies_meet_only_other_variants(spark):
    rows = [("chunks", f"k{i:04d}", "word") for i in range(3000)] + [("chunks", "z", "wоrd")]
    df = spark.createDataFrame(rows, "table_name string, record_key string, text string")
    members = C.same_looking(df)
    got = C.look_alike_pairs(members).collect()
    assert len(got) == 3000 and {r.key_b for r in got} == {"z"}
    rows = C.classes(members).collect()
    assert len(rows) == 3001 and {(r.records, r.variants) for r in rows} == {(3001, 2)} and len({r.class_id for r in rows}) == 1
