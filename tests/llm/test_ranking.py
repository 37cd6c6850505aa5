import math
import random
import re

import numpy as np

from custlattice.llm import ranking

from .conftest import ODD, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item, text in dict.fromkeys(items):
        own, found = set(terms(text)), []
        df = {t: sum(t in w for _, w in held) for t in own}
        for i, w in held:
            score = 0
            for t in own & set(w):
                m = 100 - 90 + 90 * len(w) * n // total
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


def corpus():
    rng = random.Random(4)
    texts = [prose(i, rng.randrange(1, 60), 120) for i in range(120)]
    texts += ["W1-w2, W2 é1 naïve 日本"] * 30 + [texts[5].upper()] * 15 + [t for t in ODD]
    items = [(i, prose(900 + i, 12, 120)) for i in range(20)] + [(50, "É1 é1 w2"), (51, None), (52, "!!"), (53, "absent"), (1, "w1 naïve"), (50, "É1 é1 w2")]
    return list(enumerate(texts)) + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")], items


def test_matches_brute_force(spark, docs_of):
    docs, items = corpus()
    got = ranking.ranked(docs_of(docs).repartition(6), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_hash_collisions_are_told_apart(spark, docs_of):
    docs, items = corpus()
    got = ranking.ranked(docs_of(docs), items_of(spark, items), bits=1)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_several_passes_and_few_cells(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ranking, "ITEMS", 6)
    monkeypatch.setattr(ranking, "CELLS", 16)
    docs, items = corpus()
    assert sorted(map(tuple, ranking.ranked(docs_of(docs), items_of(spark, items)).collect()), key=str) == plain(docs, items)


def test_classes_merge_equal_bags(spark, docs_of):
    _, items = corpus()
    block = next(ranking._blocks(items_of(spark, items)))
    bags = ranking._bags(docs_of(["w1 w2"] * 40 + ["w2 W1", "w1 w2 w2"]), spark.sparkContext.broadcast(block))
    found = ranking.classes(bags, 42, 85, 10).collect()
    assert sorted(r.ids for r in found) == [list(range(10)), [41]]


def test_empty_tables(spark, docs_of):
    docs, items = docs_of(["w1"]), items_of(spark, [(1, "w1")])
    assert ranking.ranked(docs.limit(0), items).count() == 0
    assert ranking.ranked(docs, items.limit(0)).count() == 0
    assert ranking.ranked(docs_of([None, "  "]), items).count() == 0


def test_numbers_survive_packing():
    values = np.array([0, 1, 127, 128, 300, 16384, 2**35, 2**62, 5], dtype=np.int64)
    raw, start = ranking.packed(values)
    assert ranking.unpacked(raw).tolist() == values.tolist() and start[-1] == len(raw)
    assert ranking.unpacked(raw[:0]).tolist() == []
