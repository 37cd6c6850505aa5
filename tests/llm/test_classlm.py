import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlattice.llm import classlm
from custlattice.llm.staging import fold, table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_counts_and_base_score(spark, docs_of, monkeypatch):
    texts = [*ODD, "a b c", "b c unseen", "same again"]
    train = docs_of(texts[:-2])
    c = Counter(x for t in texts[:-2] for x in tokens(t))
    n, v = c.total(), len(c)
    for head in (classlm.HEAD, 2):
        monkeypatch.setattr(classlm, "HEAD", head)
        made, counts = classlm.fit(train)
        assert (made.tokens, made.words) == (n, v) and len(made.classes.head.keys) <= head
        got = {r.doc_id: r for r in classlm.scores(docs_of(texts), made, counts).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            own = tokens(t)
            base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(c[x] > 0 for x in own), n)
            assert math.isclose(got[i].base_score, base, rel_tol=1e-9)


def test_probabilities_sum_to_one(spark, docs_of):
    texts = ["a b a", "b c", "c a b", None]
    made, counts = classlm.fit(docs_of(texts))
    assert np.allclose((10**made.transition).sum(axis=1), 1)
    # one-word texts: all known words, and one unseen word for each class that has room for it
    n = {r.word: r.n for r in counts.collect()}
    of = made.classes.of(np.array(list(n), dtype=np.int64).view(np.uint64), np.array([r.ending for r in counts.collect()], dtype=np.int64))
    for c in range(made.classes.n):
        own = sum(x + 0.5 for x, k in zip(n.values(), of, strict=True) if k == c)
        assert math.isclose((own + 0.5) / 10 ** made.norm[c], 1, rel_tol=1e-9)


def likelihood(pairs, own, classes):
    member = np.eye(classes)[own]
    t = member.T @ pairs @ member
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


def test_exchange_reaches_a_local_maximum():
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 3, 40)
    pairs = rng.poisson(np.where(kind[:, None] == kind, 8.0, 0.3)).astype(float)
    own = classlm.exchange(pairs, classes=5, rounds=50)
    assert own[0] == 0 and (own[1:] > 0).all()
    best = likelihood(pairs, own, 5)
    for i in range(1, 40):
        for c in range(1, 5):
            other = own.copy()
            other[i] = c
            assert likelihood(pairs, other, 5) <= best + 1e-6


def hashed(word):
    """Hash and ending group of a word, by a text that holds it alone."""
    raw = np.frombuffer(word, dtype=np.uint8)
    h, group, _ = classlm._tokens(classlm.words(raw, np.array([0, len(raw)])))
    return h[:1], group[:1]


@pytest.mark.parametrize("head", [classlm.HEAD, 12])
def test_score_equals_the_formula(spark, docs_of, monkeypatch, head):
    """Scores by counts of plain Python, with the model's class of each word; words beyond the head and unseen ones included."""
    monkeypatch.setattr(classlm, "ITEMS", 4)
    monkeypatch.setattr(classlm, "HEAD", head)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}{'abc'[i % 3]}" for i in range(40)]
    texts = [*ODD, *(" ".join(vocabulary[min(int(x), 39)] for x in rng.exponential(8, 30)) for _ in range(60))]
    made, counts = classlm.fit(docs_of(texts).repartition(3))
    of = {w: 0 if w is None else int(made.classes.of(*hashed(w))[0]) for t in [*texts, "unseen words"] for w in tokens(t)}
    c = Counter(x for t in texts for x in tokens(t))
    pairs = Counter(p for t in texts for p in zip([0, *[of[x] for x in tokens(t)]], [of[x] for x in tokens(t)]))
    n = made.classes.n
    after, size = Counter(), Counter()
    for (a, b), k in pairs.items():
        after[a] += k
        size[b] += k
    kinds = Counter(of[w] for w in c)

    def p(a, w):
        b = of[w]
        share = (size[b] + 0.5) / (size.total() + 0.5 * n)
        return (pairs[a, b] + 5 * share) / (after[a] + 5) * (c[w] + 0.5) / (size[b] + 0.5 * (kinds[b] + 1))

    asked = [*texts, "unseen words w1b", "w39a w38c w37b"]
    got = {r.doc_id: r.score for r in classlm.scores(docs_of(asked), made, counts).collect()}
    for i, t in enumerate(asked):
        own = tokens(t)
        assert math.isclose(got[i], sum(math.log10(p(of[a] if a else 0, w)) for a, w in zip([None, *own], own)), rel_tol=1e-9)


def test_words_beyond_the_first_items_are_classed_by_their_neighbours(spark, docs_of, monkeypatch):
    """Nouns follow 'the' and verbs follow 'they'; all have the same ending, so the groups of endings cannot tell them apart. One of each is an item."""
    monkeypatch.setattr(classlm, "ITEMS", 8)
    nouns, verbs = [f"n{i}xyz" for i in range(30)], [f"v{i}xyz" for i in range(30)]
    texts = [f"the {nouns[i // 2 % 30 * (i % 2)]} stood there . they {verbs[i // 2 % 30 * (i % 2)]} it ." for i in range(1800)]
    made, _ = classlm.fit(docs_of(texts).repartition(3))
    of = lambda some: {int(made.classes.of(*hashed(w.encode()))[0]) for w in some}
    assert not of(nouns) & of(verbs) and 0 not in of(nouns) | of(verbs)
    # a word of the same ending that was never seen has the class of the group
    assert of(["unseenxyz"]) == {int(made.classes.ending_class[hashed(b"unseenxyz")[1][0]])}


def test_best_class_is_the_best_of_all_moves():
    """Against the likelihood of each move, written out: words whose neighbours are never of the classes that they move between."""
    rng = np.random.default_rng(5)
    pairs = rng.poisson(3.0, (30, 30)).astype(float)
    own = rng.integers(1, 6, 30)
    own[0] = 0
    own[20:] = rng.integers(6, 9, 10)
    pairs[1:20, 1:20] = pairs[20:, 20:] = 0  # items 1 to 19, of classes 1 to 5, meet only the others, of classes 6 to 8
    member = np.eye(9)[own]
    table = member.T @ pairs @ member
    for i in range(1, 20):
        cells = np.concatenate([pairs[:, i] @ member, pairs[i] @ member])
        at = np.flatnonzero(cells)
        new = int(classlm.best_classes(table, own[i : i + 1], np.zeros(len(at), dtype=int), at, cells[at])[0])
        got = []
        for c in range(1, 6):
            other = own.copy()
            other[i] = c
            got.append(likelihood(pairs, other, 9))
        best = likelihood(pairs, np.where(np.arange(30) == i, new, own), 9)
        assert new < 6 and best >= max(got) - 1e-6


def test_more_words_more_classes_and_no_less_likelihood(spark, monkeypatch):
    assert [classlm.classes_for(v) for v in (0, 48**3, 1_000_000, 10**12)] == [48, 48, 100, 128]
    docs = table(spark, SF, "documents").where(fold(F.col("doc_id"), 5) != 1)
    seen = []
    whole = classlm.exchange_all

    def watched(*args):
        out = whole(*args)
        seen.append((classlm.likelihood(args[3]), classlm.likelihood(out[1]), (args[1].head_class != out[0].head_class).sum()))
        return out

    monkeypatch.setattr(classlm, "exchange_all", watched)
    made, _ = classlm.fit(docs)
    (before, after, moved), = seen
    assert after > before and moved > 0
    assert np.array_equal(classlm.class_pairs(docs, made.classes).sum(), made.tokens)


def test_number_of_classes_does_not_hang_on_the_last_digit(monkeypatch):
    cbrt = np.cbrt
    for towards in (0, np.inf):
        monkeypatch.setattr(np, "cbrt", lambda x: np.nextafter(cbrt(x), towards))
        assert [classlm.classes_for(v) for v in (48**3 - 1, 48**3, 48**3 + 1, 10**6, 10**6 + 1, 128**3)] == [48, 48, 49, 100, 101, 128]


def test_beats_word_counts_on_held_out_texts(spark):
    docs = table(spark, SF, "documents")
    held = fold(F.col("doc_id"), 5) == 1
    made, counts = classlm.fit(docs.where(~held))
    gain = classlm.scores(docs.where(held), made, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert gain[0] > gain[1]


def test_empty_tables(spark, docs_of):
    made, counts = classlm.fit(docs_of(["a"]).limit(0))
    rows = classlm.scores(docs_of(["a b", None]), made, counts).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0), (0, 0)] and all(math.isfinite(r.score) for r in rows)
    made, counts = classlm.fit(docs_of(["a"]))
    assert classlm.scores(docs_of(["a"]).limit(0), made, counts).count() == 0
