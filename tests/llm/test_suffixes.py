import random

from custlattice.llm import suffixes
from custlattice.llm.suffixes import PASSAGE, repeated_spans, without_repeats

from .conftest import ODD, prose


def plain_repeated(texts):
    """Per document the word positions in some window of PASSAGE words that occurs more than once."""
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for a in range(len(w) - PASSAGE + 1):
            seen.setdefault(tuple(w[a : a + PASSAGE]), []).append((i, a))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                out.setdefault(i, set()).update(range(a, a + PASSAGE))
    return out


def planted(n=30):
    rng = random.Random(11)
    shared = [prose(1000 + i, size) for i, size in enumerate((50, 51, 60, 120, 400, 49))]
    texts = []
    for i in range(n):
        words = prose(i, rng.randrange(5, 400)).split()
        for s in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = s.upper().split() if i % 2 else s.split()
        texts.append(" ".join(words))
    return [*texts, texts[0], texts[3], *[t for t in ODD if t is None or len(t) < 1000]]


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_matches_all_windows(spark, docs_of):
    texts = planted()
    rows = repeated_spans(docs_of(texts)).collect()
    expected = plain_repeated(texts)
    assert len(expected) > 10 and covered(rows) == expected
    assert all(r.first_doc_id <= r.doc_id for r in rows)


def test_result_does_not_depend_on_partitions(spark, docs_of):
    texts = planted()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            results.append(sorted(map(tuple, repeated_spans(docs_of(texts)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]


def test_first_occurrence_stays(spark, docs_of):
    passage = prose(77, 80)
    a, b, c = (prose(s, 30) for s in (1, 2, 3))
    docs = docs_of([f"{a}\n{passage} {b}", f"{passage}\n{c}", f"{b} {passage}", passage, None, "", "short"])
    out = without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: f"{a}\n{passage} {b}", 1: c, 2: f"{b} ", 4: None, 5: "", 6: "short"}
    assert {r.doc_id: r.n_chars for r in out.collect()}[1] == len(c)
    assert without_repeats(docs.limit(0)).count() == 0


def test_periodic_text_keeps_its_beginning(spark, docs_of):
    got = without_repeats(docs_of(["la " * 500, prose(1, 100)])).collect()
    assert {r.doc_id: len(r.text.split()) for r in got} == {0: PASSAGE, 1: 100}


def test_rows_equal_in_id_and_text_are_one(spark, docs_of):
    p = prose(5, 60)
    docs = docs_of([(1, p), (1, p), (1, p + " more"), (None, p)])
    kept = [r.text for r in without_repeats(docs).collect()]
    assert len([t for t in kept if p in t]) >= 1


def test_common_words():
    assert suffixes.common_words(b"", b"abcd") == 0
    assert suffixes.common_words(b"abcdefgh", b"abcdefgi") == 1
    assert suffixes.common_words(b"abcdefgh", b"abcdefghijkl") == 2
    assert suffixes.common_words(b"\0\0\0\1", b"\0\0\0\2") == 0


def test_left_heavy_pair_among_many_contexts_of_one_line(spark, docs_of):
    line = prose(2000, 15)
    before = prose(9018, 36)  # the smallest of its 11-word hashes lies in the line
    texts = [f"{prose(3000 + i, 60)} {line} {prose(6000 + i, 60)}" for i in range(400)]
    for i in (50, 150, 250, 350):
        texts[i] = f"{before} {line} {prose(6000 + i, 60)}"
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = repeated_spans(docs_of(texts).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert covered(rows) == plain_repeated(texts)
    assert {(r.doc_id, r.is_first, r.first_doc_id) for r in rows} == {(50, True, 50), (150, False, 50), (250, False, 50), (350, False, 50)}


def test_passages_around_a_shared_one_are_not_lost(spark, docs_of):
    for seed in range(4):
        shared, left = prose(4000 + seed, 80), prose(4100 + seed, 39)
        texts = [f"{prose(4200 + seed, 60)} {shared}", f"{left} {shared}", f"{prose(4300 + seed, 60)} {left} {shared}"]
        kept = [r.text.lower().split() for r in without_repeats(docs_of(texts)).collect()]
        left_over = {tuple(w[a : a + PASSAGE]) for w in kept for a in range(len(w) - PASSAGE + 1)}
        places = {}
        for i, t in enumerate(texts):
            w = t.split()
            for a in range(len(w) - PASSAGE + 1):
                places.setdefault(tuple(w[a : a + PASSAGE]), []).append(i)
        assert {p for p, at in places.items() if len(at) > 1} <= left_over
        assert all(any(w[a : a + PASSAGE].count(x) for w in kept for a in range(0, len(w), PASSAGE)) for x in left.split())
        assert all(sum(tuple(w[a : a + PASSAGE]) == p for w in kept for a in range(len(w) - PASSAGE + 1)) == 1 for p, at in places.items() if len(at) > 1)


def plain_spans(texts):
    """(document, first word, last word, whether it leads) of all passages that repeat, one by one."""
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for a in range(len(w) - PASSAGE + 1):
            seen.setdefault(tuple(w[a : a + PASSAGE]), []).append((i, a))
    return {(i, a): (i, a) == places[0] for places in seen.values() if len(places) > 1 for i, a in places}


def mixed(seed, n=120):
    """Texts around one line that agree with others to the left, to the right, to both sides or not at all, in all orders."""
    rng = random.Random(seed)
    line = prose(5000 + seed, rng.choice((11, 15, 30)))
    left = [prose(5100 + 10 * seed + i, 60) for i in range(6)]
    right = [prose(5200 + 10 * seed + i, 60) for i in range(6)]
    out = []
    for i in range(n):
        a, b = (rng.choice(side).split() if rng.random() < 0.8 else prose(6000 + 1000 * seed + i, 60).split() for side in (left, right))
        cut = rng.choice((0, 5, 20, 40))
        out.append(" ".join([*prose(7000 + i, 8).split()[: rng.randrange(8)], *a[cut:], line, *b[: 60 - rng.choice((0, 10, 35))]]))
    return out + out[:5] + [f"{out[7]} {out[9]}"]


def test_passages_that_are_no_neighbours(spark, docs_of):
    for seed, hot in ((1, 4096), (2, 4096), (3, 5)):
        texts = mixed(seed)
        rows = repeated_spans(docs_of(texts).repartition(3), hot).collect()
        expected = plain_spans(texts)
        firsts, words = {}, {}
        for (i, a), leads in expected.items():
            words.setdefault(i, set()).update(range(a, a + PASSAGE))
            if leads:
                firsts.setdefault(i, set()).update(range(a, a + PASSAGE))
        assert covered(rows) == words
        assert covered([r for r in rows if r.is_first]) == firsts


def test_hot_minimisers_change_nothing(spark, docs_of):
    docs = docs_of(planted())
    assert sorted(map(tuple, repeated_spans(docs, 1).collect())) == sorted(map(tuple, repeated_spans(docs).collect()))
