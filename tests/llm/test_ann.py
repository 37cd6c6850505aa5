import numpy as np
from pyspark.sql import functions as F

from custlattice.llm import ann
from custlattice.llm.staging import table

KIND = "vec_id bigint, embedding array<float>, label int, list int, ids string"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in vectors], KIND)


def brute(vectors, queries, k=5):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        for i, x in good:
            if i == q:
                got = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 12), j) for j, y in good if j != q)
                out[q] = [j for _, j in got[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1, 0, 0]), (1, [1, 0, 0]), (2, [0, 0, 0]), (3, None), (4, [1, nan, 0]), (5, [inf, 0, 0]), (6, [1, None, 0]), (None, [1, 0, 0])]
    vectors += [(i, [1, 0.5, 0]) for i in range(10, 30)] + [(50, [1, 0.5, 0]), (51, [-1, 2, 0]), (51, [-1, 2, 0]), (100, [0, 0, 1e30]), (7, [])]
    got = found(ann.nearest(rows_of(spark, vectors), F.col("vec_id") % 50 == 0))
    assert got == brute([v for v in vectors if v[1] != []], (0, 50, 100))


def test_few_candidates(spark):
    for n in (0, 1, 2, 4):
        vectors = [(i, [1.0, i]) for i in range(n)]
        assert found(ann.nearest(rows_of(spark, vectors), F.lit(True))) == {q: v for q, v in brute(vectors, range(n)).items() if v}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 100)  # lists are cut, too
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = found(ann.nearest(rows, F.col("vec_id") % 50 == 0))
    vectors = [(r.vec_id, r.embedding) for r in rows.collect()]
    expected = brute(vectors, [i for i, _ in vectors if i % 50 == 0])
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    hit = sum(len(set(got[q]) & set(v)) for q, v in expected.items())
    assert hit >= 0.95 * 5 * len(expected)


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(8)
    x = ann.unit(rng.normal(size=(3000, 16)))
    graph = ann.Graph.of(ann.centroids(x, 300))
    ids, d = graph.search(x[:500])
    assert (np.diff(d, axis=1) >= 0).all()
    assert (ids[:, 0] == np.argmax(x[:500] @ graph.centroids.T, axis=1)).mean() > 0.99
