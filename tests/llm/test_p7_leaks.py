import random
import resource

import numpy as np
import pyarrow as pa

from quillspark.llm import leaks as K

VOCAB = [f"{a}{b}" for a in ("al", "be", "co", "du", "ex", "fi", "gra", "hel") for b in ("man", "tor", "nel", "vis", "dra", "pol", "ken", "sor", "mi", "ta")]


def made(seed=0):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = [(i, words(rng.choice([50, 80, 118, 170, 20]))) for i in range(25)]
    docs, want = [], set()
    for n in range(300):
        body = words(rng.randint(0, 200))
        if n % 3 == 0:
            i, w = items[n % 25]
            share = rng.choice([0.55, 0.7, 1.0])
            size = int(len(w) * share) + 1
            at = rng.randint(0, len(w) - min(size, len(w)))
            part = w[at : at + size]
            for _ in range(len(part) // 25):  # single changed, dropped or added words
                k = rng.randrange(1, len(part) - 1)
                part = rng.choice([part[:k] + ["xx"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["yy"] + part[k:]])
            body = body[:50] + part + body[50:]
            want.add((n, i))
        elif n % 3 == 1:
            _, w = items[n % 25]
            body = body + w[: int(len(w) * 0.3)]
        text = " ".join(body)
        if n % 2:
            text = text.replace(" ", ",\n", 3).upper()
        if n % 5 == 0:
            text = text.replace("a", "а").replace("man", "<b>man</b>") if False else text.replace("a", "а")
        docs.append((n, text))
    return items, docs, want


def frames(spark, items, docs):
    d = spark.createDataFrame(docs + [(900, None), (901, "")] + docs[:4], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(77, None), (78, "")], "item_id long, passage string")
    return d, i


def test_finds_planted(spark):
    items, docs, want = made()
    d, i = frames(spark, items, docs)
    assert {tuple(r) for r in K.leaks(d, i).collect()} == want


def test_blocks_and_layout(spark):
    items, docs, want = made(3)
    d, i = frames(spark, items, docs)
    assert {tuple(r) for r in K.leaks(d, i, block_chars=3000).collect()} == want
    passage = " ".join(items[0][1])
    broken = passage.replace("man", "m-\nan")
    marked = " ".join(f"**{w}**" if k % 4 == 0 else f"<i>{w}</i>" for k, w in enumerate(items[0][1]))
    odd = spark.createDataFrame([(1, broken), (2, marked), (3, ". ".join(passage.split()))], "doc_id long, text string")
    assert {r.doc_id for r in K.leaks(odd, i).filter("item_id = 0").collect()} == {1, 2, 3}


def test_shorter_quotations_are_not_leaks(spark):
    items, _, _ = made(5)
    w = items[1][1]
    rows = [(1, " ".join(w[: int(len(w) * 0.42)])), (2, " ".join(reversed(w))), (3, " ".join(sorted(w)))]
    _, i = frames(spark, items, [])
    assert K.leaks(spark.createDataFrame(rows, "doc_id long, text string"), i).filter("item_id = 1").count() == 0


def test_no_items_and_no_documents(spark):
    items, docs, _ = made(1)
    d, i = frames(spark, items, docs[:5])
    assert K.leaks(d, i.limit(0)).count() == 0 and K.leaks(d.limit(0), i).count() == 0


def test_one_very_long_document(spark):
    items, _, _ = made(2)
    rng = random.Random(9)
    text = " ".join(rng.choice(VOCAB) for _ in range(400_000)) + " " + " ".join(items[2][1])
    _, i = frames(spark, items, [])
    got = {tuple(r) for r in K.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), i).collect()}
    assert (1, 2) in got


def near(pattern, text, errors):
    """Whether ``pattern`` lies in ``text`` within so many edits, by the table of distances."""
    row = list(range(len(pattern) + 1))
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
        if row[-1] <= errors:
            return True
    return row[-1] <= errors


def test_equals_brute_force():
    rng = random.Random(11)
    few = VOCAB[:25]  # many chance hits
    items = [[rng.choice(few) for _ in range(n)] for n in (3, 9, 21, 40, 131, 140, 160)]
    docs = []
    for n in range(56):
        body = [rng.choice(few) for _ in range(rng.randint(0, 60))]
        w = items[n % len(items)]
        size = max(1, int(len(w) * rng.choice([0.45, 0.5, 0.52, 0.6, 1.0])))
        at = rng.randint(0, len(w) - size)
        part = w[at : at + size]
        for _ in range(int(len(part) * rng.choice([0, 0.05, 0.1, 0.14]))):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + ["xx"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["yy"] + part[k:]]) or ["zz"]
        docs.append(body + part + [rng.choice(few) for _ in range(rng.randint(0, 30))])
    built = K.Items(np.arange(len(items)), pa.array([" ".join(w) for w in items]), K.SHARE, K.ERRORS)
    got = set(zip(*(x.tolist() for x in built.matches(pa.array([" ".join(x) for x in docs])))))
    want = set()
    for d, text in enumerate(docs):
        for i, w in enumerate(items):
            need = -(-len(w) // 2)
            if any(near(w[s : s + need], text, need // 10) for s in range(len(w) - need + 1)):
                want.add((d, i))
    assert got == want and len(want) > 20


def test_ten_thousand_items_fit():
    rng = np.random.default_rng(3)
    made_up = np.array([f"w{i}" for i in range(150_000)])
    passages = [" ".join(made_up[rng.integers(0, 150_000, 60)]) for _ in range(10_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    items = K.Items(np.arange(10_000), pa.array(passages), K.SHARE, K.ERRORS)
    text, item = items.matches(pa.array([passages[77] + " and more", "nothing", passages[9_999]]))
    assert set(zip(text.tolist(), item.tolist())) == {(0, 77), (2, 9_999)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_markup_of_any_length(spark):
    items, _, _ = made(4)
    passage = items[0][1]
    long = " ".join(f'<span class="{"x" * 300}" data-a="1 2">{w}</span>' if k % 3 == 0 else f"[{w}](https://{'a' * 400}.example/x)" if k % 3 == 1 else f"<!-- {'note ' * 40}-->{w}" for k, w in enumerate(passage))
    _, i = frames(spark, items, [])
    assert {r.item_id for r in K.leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), i).collect()} >= {0}
