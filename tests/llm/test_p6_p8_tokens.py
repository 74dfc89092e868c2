import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import packing as K
from quillspark.llm import splitting as S
from quillspark.llm.tokens import hashes, tokenizer

try:
    TOK = tokenizer()
except OSError:
    pytest.skip("no vocabulary here", allow_module_level=True)
ALPHABET = st.sampled_from(list(" \n\t'strevmld.,!?aB9é漢 　") + ["'s", "'re", "  ", "\n\n", "'ll", "word", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), max_size=4))
def test_counts_equal_the_tokenizer(texts):
    assert TOK.counts(texts).tolist() == [TOK.count(x) for x in texts]


def test_counts_of_null_and_very_long():
    long = "aneurysm repair, " * 200_000
    assert TOK.counts([None, "", long, "a" * 3_000_000][:3]).tolist() == [0, 0, TOK.count(long)]


def test_hashes_differ_by_place_only():
    flat = np.array([1, 2, 3, 0, 1, 2, 3], dtype=np.uint32)
    h = hashes(flat, np.array([0, 4, 1]), np.array([3, 7, 3]))
    assert h[0] == h[1] != h[2]


def first_fit(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(rooms) if r >= sizes[i]), None)
        if b is None:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_tree_is_first_fit_decreasing(sizes):
    assert K.first_fit_decreasing(np.array(sizes, dtype=np.int64), 20).tolist() == first_fit(sizes, 20)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 3, 50, 99, 100, 101, 250])) for i in range(500)] + [(7, 50), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("group_no", K.F.lit(5))
    out = K.pack(df, "doc_id", 100, group_items=100).toPandas()
    assert out.groupby(["group_no", "container_no"]).piece_tokens.sum().max() <= 100
    assert out.piece_tokens.sum() == sum(n or 0 for _, n in rows)
    whole = out.groupby("doc_id").size()
    small = [i for i, n in rows if (n or 0) <= 100 and i != 7]
    assert (whole.loc[small] == 1).all() and out.group_no.nunique() > 1
    assert out.piece_tokens.sum() / (out.groupby(["group_no", "container_no"]).ngroups * 100) > 0.9
    assert K.pack(df.limit(0), "doc_id").count() == 0


def check(text, limit=60, overlap=8):
    pieces = dict(S.split([text], TOK, limit, overlap)).get(0)
    if TOK.count(text) <= limit:
        assert pieces is None
        return []
    assert pieces[0][0] == pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for (a, c, b, n), nxt in zip(pieces, [*pieces[1:], None]):
        assert a <= c < b and TOK.count(text[a:b]) == n <= limit
        assert TOK.count(text[a:c]) <= overlap + 1
        if nxt:
            assert nxt[1] == b
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=50, max_size=400).map("".join))
def test_pieces(text):
    check(text)


def test_pieces_of_odd_texts():
    for text in ("a" * 3000, "é" * 900, "\n" * 900, "漢" * 700, "🙂" * 400, " " * 2000, "x," * 900, "word " * 300 + "\n\n\n", "", "short"):
        check(text)


def test_cuts_are_natural():
    text = "\n\n".join(" ".join(f"This is sentence {i} of paragraph {p}." for i in range(4)) for p in range(12))
    ends = [text[:b] for _, _, b, _ in check(text)[:-1]]
    assert all(x.endswith("\n\n") for x in ends)
    one = " ".join(f"This is sentence number {i} of one paragraph." for i in range(60))
    assert all(one[:b].rstrip().endswith(".") for _, _, b, _ in check(one))


def test_overlap_is_words_of_the_piece_before():
    text = "some words " * 200
    pieces = check(text)
    assert all(TOK.count(text[a:c]) >= 7 for a, c, _, _ in pieces[1:])


def test_table(spark):
    df = spark.createDataFrame([(1, "word " * 700), (2, None), (3, ""), (4, "short"), (1, "word " * 700)], "doc_id long, text string")
    rows = S.split_oversized(df, "doc_id").collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) % 2 == 0 and all(r.n_tokens <= 512 for r in rows)
    with pytest.raises(ValueError):
        S.split_oversized(df, "doc_id", 10, 10)
