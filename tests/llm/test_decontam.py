import random
from collections import Counter

import numpy as np

from custlattice.llm import decontam

from .conftest import ODD, prose


def plain(texts, items):
    """All windows of each item's length, by weighted Jaccard over word shingles."""

    def shingles(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, item in enumerate(items):
            x = (item or "").lower().split()
            for a in range(len(w) - len(x) + 1) if x else ():
                p, q = shingles(w[a : a + len(x)]), shingles(x)
                s = (p & q).total() / (p | q).total()
                if s >= 0.8 and s > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (a, s)
    return out


def test_matches_all_windows(spark, docs_of):
    rng = random.Random(3)
    items = [prose(500 + i, n) for i, n in enumerate((1, 3, 5, 12, 20, 40, 41, 70, 100))]
    items += [None, "", items[4], "b a " * 10]
    texts = [t for t in ODD if t is None or len(t) < 1000]
    for s in range(40):
        w = prose(s, 200).split()
        x = rng.choice([i for i in items if i]).split()
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = "edited"
        at = rng.randrange(len(w))
        w[at:at] = x
        texts.append(" ".join(w))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontam.contaminated(docs_of(texts), benchmark).collect()}
    expected = plain(texts, items)
    assert len(expected) > 20
    assert {k: (a, round(s, 9)) for k, (a, s) in got.items()} == {k: (a, round(s, 9)) for k, (a, s) in expected.items()}
    kept = {r.doc_id for r in decontam.without_contaminated(docs_of(texts), benchmark).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in expected}


def test_blocks_of_a_large_benchmark_give_the_same(spark, docs_of, monkeypatch):
    items = [prose(s, 30) for s in range(12)]
    texts = [prose(100, 50) + " " + items[i] for i in (0, 5, 11)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs_of(texts), benchmark).collect()))
    monkeypatch.setattr(decontam, "ITEMS", 6)
    assert sorted(map(tuple, decontam.contaminated(docs_of(texts), benchmark).collect())) == whole
    assert len(whole) == 3


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], none.schema)
    assert decontam.contaminated(docs_of(["a b"]), none).count() == 0
    assert decontam.contaminated(docs_of(["a b"]).limit(0), some).count() == 0
    assert decontam.without_contaminated(docs_of(["a b", None]), none).count() == 2


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**64, 200, dtype=np.uint64)
    index = decontam.HammingIndex(prints)
    for _ in range(50):
        x = int(prints[rng.integers(200)])
        for b in rng.choice(64, decontam.RADIUS, replace=False):
            x ^= 1 << int(b)
        expected = {i: (x ^ int(p)).bit_count() for i, p in enumerate(prints.tolist())}
        assert index.search(x) == {i: d for i, d in expected.items() if d <= decontam.RADIUS}


def test_texts_shorter_than_the_item(spark, docs_of):
    items = [prose(700 + i, n) for i, n in enumerate((40, 15, 9, 6, 5, 4))]
    texts = [" ".join(t.split()[a : len(t.split()) - b]) for t in items for a in range(3) for b in range(9) if a + b]

    def shingles(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p, q = shingles(t.split()), shingles(item.split())
            if len(t.split()) < len(item.split()) and (p & q).total() >= 0.8 * (p | q).total():
                expected[d, i] = (0, len(t.split()), (p & q).total() / (p | q).total(), 1)
    assert len(expected) > 10
    docs = docs_of(texts)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.words, r.similarity, r.windows) for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == expected
    assert {r.doc_id for r in decontam.without_contaminated(docs, benchmark).collect()} == set(range(len(texts))) - {d for d, _ in expected}
