"""The pipeline's stages against plain versions of their decisions, on the smallest sample tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from custlattice.llm import queries, toxicity
from custlattice.llm.staging import shared_dir, staged, table
from custlattice.llm.suffixes import PASSAGE

from .test_decontam import plain
from .test_packing import check_sequences, model
from .test_suffixes import plain_repeated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    scored = toxicity.toxic_scores(stages[0], toxicity.fit(stages[0], table(spark, SF, "labels")))
    assert set(texts(stages[1])) == {r.doc_id for r in scored.where("predicted = 0").collect()}
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = set(texts(stages[0])) - set(texts(stages[1]))
    assert gone & toxic and len(gone) < 0.3 * stages[0].count()


def groups_by_similarity(before, least):
    """Label of each document: documents are linked at a similarity of `least` or more."""
    sets = {i: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set()) for i, t in before.items()}
    label = {i: i for i in before}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and label[i] != label[j] and (a == b or len(a & b) >= least * len(a | b)):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def test_near_copies_go(stages):
    before, kept = texts(stages[1]), texts(stages[2])
    assert all(before[i] == t for i, t in kept.items())
    surely, perhaps = groups_by_similarity(before, 0.85), groups_by_similarity(before, 0.65)
    assert len(set(surely.values())) < len(before)
    assert len({surely[i] for i in kept}) == len(kept)
    assert {perhaps[i] for i in kept} == set(perhaps.values()) and all(perhaps[i] in kept for i in before)


def test_repeated_passages_go(stages):
    before, after = texts(stages[2]), texts(stages[3])
    ids = list(before)
    repeated = {ids[i]: w for i, w in plain_repeated([before[i] for i in ids]).items()}
    for i in ids:
        words = (before[i] or "").split()
        left = (after.get(i) or "").split()
        if i not in repeated:
            assert after[i] == before[i]
        else:  # words outside stay, in order
            outside = [w for k, w in enumerate(words) if k not in repeated[i]]
            it = iter(left)
            assert all(w in it for w in outside)
    # what repeats now repeats within one text, in the overlap with its own first occurrence
    places = {}
    for i, t in after.items():
        words = (t or "").encode().lower().split()
        for a in range(len(words) - PASSAGE + 1):
            places.setdefault(tuple(words[a : a + PASSAGE]), set()).add(i)
    assert all(len(p) == 1 for p in places.values())


def test_leaks_go(spark, stages):
    before = texts(stages[3])
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    ids = list(before)
    hit = {ids[d] for d, _ in plain([before[i] for i in ids], items)}
    assert texts(stages[4]) == {i: t for i, t in before.items() if i not in hit}


def test_all_tokens_are_packed(stages):
    rows, tokens = stages[5].collect(), model()
    check_sequences(rows)
    expected = sum(len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts(stages[4]).values())
    assert sum(r.length for r in rows) == expected


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    keys = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, out.select(*keys).collect())) == sorted(map(tuple, stages[5].select(*keys).collect()))


def test_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    from compare import differences

    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert differences(spark, con, SF, name) is None


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert F is not None
