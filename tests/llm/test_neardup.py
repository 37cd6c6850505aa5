import random

import numpy as np
import xxhash

from custlattice.llm import neardup
from custlattice.llm.components import components

from .conftest import ODD, prose


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, threshold=neardup.THRESHOLD):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= threshold:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
                    changed = True
    return {ids[i]: min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))}


def test_code_covers_and_pairs_meet():
    code = neardup.AnchorCode(5)
    weight = np.bitwise_count(code.patterns)
    least = np.full(1 << 14, 99)
    np.minimum.at(least, code.syndrome(code.patterns), weight)
    assert least.max() == neardup.COVERING_RADIUS
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 300, dtype=np.uint64).astype(np.uint32)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(32, 2, replace=False):
            y[i] ^= np.uint32(1 << int(b))
    sets = []
    for z in (x, y):
        row, anchor = code.anchors(z)
        assert not code.syndrome(anchor).any()
        sets.append([set(anchor[row == i].tolist()) for i in range(len(z))])
    assert all(a & b for a, b in zip(*sets))


def test_matches_all_pairs(spark, docs_of):
    rng = random.Random(5)
    texts = list(ODD)
    for s in range(12):
        words = prose(s, 400).split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    expected = plain_components(list(range(len(texts))), prints)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(texts)


def test_split_anchors_lose_no_link(spark):
    rng = np.random.default_rng(2)
    prints = [int(rng.integers(0, 2**63))]
    for _ in range(300):
        prints.append(prints[rng.integers(len(prints))] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    for chunk in (8, 100_000):
        found = components(neardup.near_links(nodes, chunk)).collect()
        roots = {p: p for p in prints} | {r.u: r.root for r in found}
        assert roots == plain_components(prints, prints)


def test_components_of_odd_edges(spark):
    edges = [(1, 2), (2, 1), (3, 3), (9, 4), (4, 7), (7, 5), (20, 21), (None, 1), (2, None)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {2: 1, 9: 4, 7: 4, 5: 4, 21: 20} | {i: 100 for i in range(101, 141)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_document_of_each_group_stays(spark, docs_of):
    docs = docs_of([(7, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (9, "p q r s t u"), (5, None)])
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "a b c d e"), (5, None), (9, "p q r s t u")]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.without_near_duplicates(docs.limit(0)).count() == 0


def test_null_ids(spark, docs_of):
    rows = neardup.near_duplicates(docs_of([(None, "only here"), (None, "b"), (4, "b")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(4, 4), (None, 4), (None, None)]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def edited(seed, n, changes):
    rng = random.Random(seed)
    words = prose(100 + seed, n).split()
    other = list(words)
    for at in rng.sample(range(n), changes):
        other[at] = f"changed{at}"
    return " ".join(words), " ".join(other)


def test_similar_texts_are_found(spark, docs_of):
    pairs = [edited(i, 200 + i % 150, 1 + i % 7) for i in range(300)]
    texts = [t for p in pairs for t in p]
    kept = {r.doc_id for r in neardup.without_similar(docs_of(texts).repartition(5)).collect()}
    alike = [i for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    assert len(alike) > 200 and all(2 * i in kept for i in range(300))
    assert sum(2 * i + 1 not in kept for i in alike) / len(alike) >= 0.95
    near = [i for i in alike if jaccard(*pairs[i]) < 0.85]
    assert sum(2 * i + 1 not in kept for i in near) / len(near) >= 0.85


def test_other_texts_stay(spark, docs_of):
    pairs = [edited(i, 200, 25) for i in range(60)]
    texts = [t for p in pairs for t in p] + [prose(i, 3) for i in range(30)] + ["same words", "Same  words", None, "", " "]
    assert all(jaccard(*p) < 0.62 for p in pairs)
    docs = docs_of(texts)
    kept = neardup.without_similar(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(153)) - {151}
    assert neardup.without_similar(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_and_split_cells(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    base, texts = prose(1, 300).split(), []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), 2):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    assert neardup.without_similar(docs_of(texts)).count() == 1
    nodes = neardup.long_fingerprints(docs_of(texts)).select("fp", "bits").distinct()
    found = components(neardup.similar_links(nodes, 16)).collect()
    assert len({r.root for r in found}) == 1 and len(found) == len({r.fp for r in nodes.collect()}) - 1


def test_a_piece_near_to_an_unlike_fingerprint_hides_no_link(spark):
    rng = np.random.default_rng(4)
    rows, pairs = [], []
    for i in range(40):
        one = rng.integers(0, 2**32, 16, dtype=np.uint64).astype(np.uint32)
        other, third = one.copy(), rng.integers(0, 2**32, 16, dtype=np.uint64).astype(np.uint32)
        other[1:] ^= np.uint32(7)  # 45 bits in the whole, three in each piece but the first
        third[0] = one[0]  # sorts first, shares the piece, and is unlike both in the whole
        rows += [(3 * i + at, x.view(np.int64).tolist()) for at, x in enumerate((third, one, other))]
        pairs.append((3 * i + 1, 3 * i + 2))
    nodes = spark.createDataFrame(rows, "fp bigint, bits array<bigint>").repartition(3)
    for chunk in (2, 100_000):
        found = {tuple(sorted((r.u, r.v))) for r in neardup.similar_links(nodes, chunk).collect()}
        assert found == set(pairs)


def test_similar_links_reach_what_all_pairs_reach(spark):
    rng = np.random.default_rng(5)
    prints = [rng.integers(0, 2**32, 16, dtype=np.uint64).astype(np.uint32)]
    for _ in range(250):
        new = prints[rng.integers(len(prints))].copy()
        for bit in rng.choice(512, int(rng.integers(30, 130)), replace=False):
            new[bit // 32] ^= np.uint32(1 << int(bit) % 32)
        prints.append(new)
    label = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            d = np.bitwise_count(x ^ y)
            if d.min() <= neardup.PIECE_THRESHOLD and d.sum() <= neardup.LONG_THRESHOLD:
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    nodes = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(prints)], "fp bigint, bits array<bigint>")
    for chunk in (8, 100_000):
        found = components(neardup.similar_links(nodes, chunk)).collect()
        roots = {i: i for i in range(len(prints))} | {r.u: r.root for r in found}
        assert [roots[i] for i in range(len(prints))] == label
    assert 1 < len(set(label)) < 200


def test_a_large_group_of_near_copies_gives_few_links(spark):
    rng = np.random.default_rng(6)
    base, rows = rng.integers(0, 2**32, 16, dtype=np.uint64).astype(np.uint32), []
    for i in range(500):
        one = base.copy()
        for bit in rng.choice(512, 20, replace=False):
            one[bit // 32] ^= np.uint32(1 << int(bit) % 32)
        rows.append((i, one.view(np.int64).tolist()))
    nodes = spark.createDataFrame(rows, "fp bigint, bits array<bigint>").repartition(3)
    for chunk in (64, 100_000):
        links = neardup.similar_links(nodes, chunk).collect()
        assert len(links) < 3 * len(rows)
        found = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
        assert {r.u: r.root for r in found} == {i: 0 for i in range(1, 500)}


def test_fingerprints_near_in_pieces_alone_are_compared_once_a_piece(spark, monkeypatch):
    compared, sent = [], neardup._group_links

    def counted(groups, nodes):
        compared.append(groups.count())
        return sent(groups, nodes)

    monkeypatch.setattr(neardup, "_group_links", counted)
    for n in (300, 1200):
        rng = np.random.default_rng(7)
        base, rows = rng.integers(0, 2**32, 16, dtype=np.uint64).astype(np.uint32), []
        for i in range(n):
            one = base.copy()
            for bit in rng.choice(512, 70, replace=False):  # two differ in about 121 bits, and often in two or fewer of a piece
                one[bit // 32] ^= np.uint32(1 << int(bit) % 32)
            rows.append((i, one.view(np.int64).tolist()))
        compared.clear()
        neardup.similar_links(spark.createDataFrame(rows, "fp bigint, bits array<bigint>").repartition(3)).collect()
        assert n < sum(compared) <= 2 * neardup.PIECES * n
