"""Every registered query against its SQL twin on DuckDB, over the whole sample tables."""

import pytest
from compare import differences
from conftest import DATA

import __spark_entry__ as entry
from custlattice.plans import registry


@pytest.fixture(scope="module", autouse=True)
def shared_workspace(spark):
    """One workspace for all queries of this module, so shared tables are built once."""
    built = {}
    original = registry.open_workspace

    def cached(session, directory):
        if directory not in built:
            built[directory] = original(session, directory)
        return built[directory]

    registry.open_workspace = cached
    yield
    registry.open_workspace = original


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) <= set(entry.oracle_sql()) & set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, DATA, name) is None


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["segment"] for r in rows} == {"Premium", "Standard", "Basic", "Enterprise"}


def test_work_folder_must_be_named(spark):
    from custlattice.sources.tables import scratch_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local[2]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session)
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
