import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlattice.llm import merkle
from custlattice.llm.staging import fold

from .conftest import ODD, prose


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(leaves):
    """Root, and for each leaf its steps."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain(rows, change):
    leaves = sorted(((r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), plain_leaf(r, change(r)))) for r in rows)
    langs = sorted({x[:2] for x in leaves})
    subroots, made = [], {}
    for lang in langs:
        own = [x for x in leaves if x[:2] == lang]
        subroot, paths = plain_tree([x[4] for x in own])
        subroots.append(subroot)
        made[lang] = own, paths
    root, tops = plain_tree(subroots)
    out = []
    for lang, subroot, top in zip(langs, subroots, tops):
        for x, path in zip(*made[lang]):
            now = x[5]
            for i, others in path + top:
                now = h(*others[:i], now, *others[i:])
            proof = h(*(o for _, others in path + top for o in others))
            out.append((x[3] if x[2] else None, x[4], subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def tampered(r):
    if r.text is not None and zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 0:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
    return r.text


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65, 3), (700, 0, 513, 20), (5,) * 11])
def test_matches_plain_tree(spark, docs_of, sizes, monkeypatch):
    rng = random.Random(1)
    docs = None
    for lang, n in enumerate(sizes):
        ids = rng.sample(range(10_000), n)
        own = docs_of([(i, f"Text {prose(i, 4).upper()}") for i in ids], None if lang == 0 else f"l{lang}é")
        docs = own if docs is None else docs.unionByName(own)
    change = F.when(fold(F.col("doc_id"), 3) == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    got = sorted(map(tuple, merkle.manifest(docs.repartition(5), change).collect()), key=str)
    assert got == plain(docs.collect(), tampered)
    assert {g[-1] for g in got} <= {True, False} and any(g[-1] for g in got) == any(tampered(r) == r.text for r in docs.collect())


def test_odd_rows(spark, docs_of):
    docs = docs_of([*enumerate(ODD), (None, "x"), (None, None), (3, "a"), (3, "a")])
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=str)
    assert got == plain(docs.collect(), lambda r: r.text) and all(g[-1] for g in got)
    assert merkle.manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 513, 1000])
def test_closed_form_positions(n):
    log = list(merkle.appended([b"%032d" % i for i in range(n)], merkle.height(n)))
    for place, (level, index, _) in enumerate(log):
        assert int(merkle.position(n, level, np.array([index]))[0]) == place
    assert log[-1][0] == merkle.height(n) and log[-1][1] == 0


def test_log_is_whole_and_proves_any_leaf(spark):
    n = 5000
    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
    nodes = spark.createDataFrame([(7, i, n, d) for i, d in enumerate(digests)], "tree bigint, idx bigint, n bigint, digest binary")
    rounds, roots = merkle.build(nodes)
    log = {r.pos: r for r in merkle.log_rows(rounds, spark.createDataFrame([(7, n)], "tree bigint, leaves bigint")).collect()}
    expected = list(merkle.appended(digests, merkle.height(n)))
    assert [(log[p].level, log[p]["index"], bytes(log[p].digest)) for p in range(len(log))] == expected
    assert [bytes(r.digest) for r in roots.collect()] == [expected[-1][2]]
    for i in (0, 7, 513, n - 1):
        now, index = digests[i], i
        for level in range(merkle.height(n)):
            run = np.arange(index // 8 * 8, min(index // 8 * 8 + 8, -(-n // 8**level)))
            found = [bytes(log[int(p)].digest) for p in merkle.position(n, level, run)]
            now, index = merkle.joined([now if r == index else d for r, d in zip(run, found)]), index // 8
        assert now == expected[-1][2]


def test_a_change_below_the_proof_is_seen(spark, docs_of):
    docs = docs_of([(i, f"T{i}") for i in range(40)])
    found = merkle.manifest(docs, F.when(F.col("doc_id") == 11, F.lit("other")).otherwise(F.col("text"))).collect()
    assert {r.doc_id for r in found if not r.verified} == {11}
