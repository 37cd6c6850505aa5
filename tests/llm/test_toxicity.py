import numpy as np
from pyspark.sql import functions as F

from custlattice.llm import toxicity
from custlattice.llm.staging import fold, table
from custlattice.llm.tokens import LETTER, word_slices

from .conftest import ODD, prose


def labelled(spark, docs_of, n=120):
    texts = [prose(i, 60) + (" you awfulbad person" if i % 4 == 0 else "") for i in range(n)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)] + [(0, 1, 1), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs_of(texts), labels


def test_finds_the_lexicon(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    made = toxicity.fit(docs, labels, lambda d: d % 3 != 0)
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, made).collect()}
    assert all(r.predicted == int(i % 4 == 0) == int(r.score >= toxicity.CUT) for i, r in got.items())
    odd = toxicity.toxic_scores(docs_of([*ODD, "AWFULBAD!"]), made).collect()
    assert [r.predicted for r in sorted(odd, key=lambda r: r.doc_id)] == [0] * len(ODD) + [1]
    assert all(0 <= r.score <= 1 and r.key == "x" for r in odd)
    assert {r.doc_id for r in toxicity.without_toxic(docs, made).collect()} == {i for i in got if i % 4}


def test_nothing_to_learn_from(spark, docs_of):
    docs, labels = labelled(spark, docs_of, 8)
    for rows in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        made = toxicity.fit(docs, rows)
        assert {round(r.score) for r in toxicity.toxic_scores(docs, made).collect()} == {int(rows.where("toxic = 1").count() > 0)}
    assert toxicity.toxic_scores(docs.limit(0), made).count() == 0
    assert len(toxicity.fit(docs.limit(0), labels).stems) == 0


def counts(text):
    made = toxicity.Grammar(toxicity._hash_words(["rotter"]), np.array([1.0]), np.zeros(len(toxicity.PATTERNS) + 1))
    made.prepare()
    (_, w), = word_slices(__import__("pyarrow").array([text]), LETTER)
    found = toxicity.patterns(w, made.lexicon, made.strength, made.fixed, made.tables)[0]
    return {p: x for p, x in zip(toxicity.PATTERNS, found.tolist(), strict=True) if x}


def test_grammar_reads_clauses():
    assert counts("a rotter came") == {"plain": 1}
    assert counts("You are a rotter") == {"plain": 1, "aimed": 1}
    assert counts("a rotter, you see") == {"plain": 1}  # another clause
    assert counts("a rotter like you") == {"plain": 1, "aimed": 1}
    assert counts("not a rotter") == {"denied": 1}
    assert counts("not one of the many rotter") == {"plain": 1}
    assert counts("never. rotter") == {"plain": 1}
    assert counts("anna said he is a rotter") == {"quoted": 1, "aimed": 1}
    assert counts("i will kill you") == {"threatening": 1, "aimed": 1}
    assert counts("i will not kill you") == {"denied": 1}
    assert counts("no words here") == {}


def test_composition_equals_the_chain():
    rng = np.random.default_rng(5)
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.threat(), toxicity.target()]
    nexts, table_counts = toxicity.grammar()
    for _ in range(200):
        symbols = rng.integers(0, len(toxicity.SYMBOLS), 12).tolist()
        states, total = [p.start for p in parts], np.zeros(len(toxicity.PATTERNS))
        state, whole = 0, np.zeros(len(toxicity.PATTERNS))
        for s in symbols:
            whole += table_counts[state, s]
            state = nexts[state, s]
            out = s
            for i, p in enumerate(parts):
                states[i], out, c = p.step(states[i], out)
                total += c
        assert (whole == total).all()


def test_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    made = toxicity.fit(docs, labels, lambda d: fold(d, 4) != 2)
    got = toxicity.toxic_scores(docs.select("doc_id", "text").where(fold(F.col("doc_id"), 4) == 2), made)
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(((r.toxic, r.predicted), r["count"]) for r in got.join(truth, "doc_id").groupBy("toxic", "predicted").count().collect())
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / n[0, 0] < 0.02
