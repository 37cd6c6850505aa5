from pyspark.sql import functions as F

from custlattice.llm import langid
from custlattice.llm.staging import fold, table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    made = langid.fit(docs, ~held)
    assert len(made.langs) > len(set(made.langs))
    got = langid.predicted(docs, made).where(held)
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    assert got.where("score < 0 or score > 1").count() == 0
    again = langid.fit(docs, ~held)
    assert (again.vectors == made.vectors).all()


def test_odd_rows(spark, docs_of):
    docs = docs_of(["the cat and the dog", "the mouse", None, ""], "en").unionByName(docs_of(["der hund und die katze", "eine maus"], "de"))
    made = langid.fit(docs, F.lit(True))
    rows = langid.predicted(docs_of([*ODD, "123 !?", "die maus und der hund", "the dog"]), made).collect()
    assert len(rows) == len(ODD) + 3 and "key" in rows[0]
    by = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, len(ODD)):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[len(ODD) + 1].lang_pred == "de" and by[len(ODD) + 2].lang_pred == "en"
    assert by[4].lang_pred in ("de", "en") and by[4].rejected
    assert by[3].lang_pred == by[6].lang_pred and by[3].score == by[6].score


def test_nothing_to_learn_from(spark, docs_of):
    for docs in (docs_of(["a b"], None), docs_of(["a b"]).limit(0)):
        made = langid.fit(docs, F.lit(True))
        assert [r.lang_pred for r in langid.predicted(docs_of(["a b", None]), made).collect()] == ["und", "und"]
        assert langid.predicted(docs.limit(0), made).count() == 0
