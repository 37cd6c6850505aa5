"""The log-structured index against a full ranking of the documents that are live, through arrivals, changes and deletions."""

import random

import pytest
from pyspark.sql import functions as F

from custlattice.operators import evidence, search_log
from custlattice.sources import snapshots

CORPUS = "doc_id string, customer_id string, source_type string, content string, sentiment string, moment_type string, event_date timestamp_ntz, deleted boolean"


def row(doc, content, deleted=False, sentiment="NEUTRAL", day="2024-01-01"):
    return doc, f"C{hash(doc) % 3}", "NOTE", content, sentiment, "UNCLASSIFIED", day, deleted


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], None, r[7]) for r in rows], CORPUS).withColumn("event_date", F.lit("2024-01-01").cast("timestamp_ntz"))


def text(rng):
    return " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(1, 12)))


def same_ranking(spark, index, live, queries=("aa bb cc", "pp", "zz aa")):
    docs = frame(spark, [row(d, t) for d, t in live.items()]).drop("deleted")
    for q in queries:
        got, share = index.search(q, 4)
        want = evidence.search_corpus(docs, q, 4).select("doc_id", "score").collect()
        assert got.select("doc_id", "score").collect() == want
        assert 0 <= share <= 1


def test_follows_arrivals_changes_and_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_log, "BUCKET_WORDS", 40)
    rng, live, root = random.Random(5), {}, str(tmp_path / "index")
    for step in range(9):
        rows = []
        for d in rng.sample(range(40), 8):
            name = f"D{d:02d}"
            if name in live and rng.random() < 0.3:
                del live[name]
                rows.append(row(name, None, True))
            else:
                live[name] = text(rng)
                rows.append(row(name, live[name]))
        commit = search_log.refresh(spark, root, frame(spark, rows + rows[:2]))
        assert commit.value["docs"] == len(live) and commit.value["words"] == sum(len(t.split()) for t in live.values())
        levels = [s["level"] for s in commit.value["segments"]]
        assert all(levels.count(x) < search_log.TIER for x in levels)
        if step in (0, 3, 5, 8):
            index = search_log.open_log(spark, root)
            same_ranking(spark, index, live)
            assert {r.doc_id: r.content for r in index.documents.select("doc_id", "content").collect()} == live
            assert index.postings(["aa"]).count() == sum("aa" in t.split() for t in live.values())
    assert search_log.refresh(spark, root, frame(spark, [row(d, t) for d, t in live.items()])) == commit
    assert search_log.open_log(spark, root, 0).commit.value["docs"] <= 8  # an earlier state stays readable
    flt = evidence.Filters(customer_id="C1")
    docs = frame(spark, [row(d, t) for d, t in live.items()]).drop("deleted")
    got = search_log.open_log(spark, root).search("aa bb cc", 3, flt)[0].select("doc_id", "score").collect()
    assert got == evidence.search_corpus(docs, "aa bb cc", 3, flt).select("doc_id", "score").collect()


def test_changed_attributes_null_texts_and_empty_index(spark, tmp_path):
    root = str(tmp_path / "index")
    assert search_log.refresh(spark, root, frame(spark, []).drop("deleted")) is None
    with pytest.raises(ValueError):
        search_log.open_log(spark, root)
    search_log.refresh(spark, root, frame(spark, [row("a", None), row("b", "xx"), row(None, "yy")]))
    index = search_log.open_log(spark, root)
    assert sorted(r.doc_id for r in index.documents.collect()) == ["a", "b"] and index.search("yy")[0].count() == 0
    search_log.refresh(spark, root, frame(spark, [row("b", "xx", sentiment="POSITIVE")]))
    index = search_log.open_log(spark, root)
    assert [(r.doc_id, r.sentiment) for r in index.search("xx")[0].collect()] == [("b", "POSITIVE")]
    assert index.with_content(index.search("xx")[0]).first().content == "xx"
    search_log.refresh(spark, root, frame(spark, [row("a", "", True), row("b", "", True)]))
    gone = search_log.open_log(spark, root)
    assert gone.documents.count() == 0 and gone.search("xx")[0].count() == 0
    assert index.search("xx")[0].count() == 1  # a reader keeps its state


def test_bounds_skip_most_postings(spark, tmp_path):
    root, rng = str(tmp_path / "index"), random.Random(1)
    live = {f"D{i:04d}": "aa " * (1 + (i % 97 == 0) * 5) + "bb " * (i % 89 == 0) + " ".join(text(rng) for _ in range(3)) for i in range(2000)}
    search_log.refresh(spark, root, frame(spark, [row(d, t) for d, t in live.items()]))
    index = search_log.open_log(spark, root)
    same_ranking(spark, index, live, ("qq aa bb",))
    assert index.search("qq aa bb", 4)[1] < 0.5


def test_a_question_makes_postings_once_and_stored_ones_are_narrow(spark, tmp_path):
    live = {"D1": "aa bb aa", "D2": "bb  cc", "D3": "", "D4": None}
    docs = frame(spark, [row(d, t) for d, t in live.items()]).drop("deleted")
    found = evidence.search_index(evidence.build_index(docs), "aa bb")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.select("doc_id", "score").collect() == evidence.search_corpus(docs, "aa bb").select("doc_id", "score").collect()
    assert sorted((r.term, r.doc_id, r.tf, r.dl) for r in evidence.postings(docs).collect()) == [("aa", "D1", 2, 3), ("bb", "D1", 1, 3), ("bb", "D2", 1, 2), ("cc", "D2", 1, 2)]
    search_log.refresh(spark, str(tmp_path), docs)
    index = search_log.open_log(spark, str(tmp_path))
    assert set(index.postings().columns) == {"term", "doc_id", "tf", "dl", "range", "segment"}
    assert index.search("bb", 1)[0].columns == ["doc_id", "score", *evidence.ATTRIBUTES]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = str(tmp_path)
    first = snapshots.publish(spark, root, {"n": 0}, None)
    snapshots.publish(spark, root, {"n": 1}, first)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"n": 2}, first)
    assert snapshots.newest(spark, root).value == {"n": 1} and snapshots.numbers(spark, root) == [0, 1]
    assert snapshots.newest(spark, root, lambda v: v["n"] == 0).number == 0
