import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import duck, spark_session  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = spark_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return duck(DATA)


@pytest.fixture
def as_of():
    return datetime(2024, 1, 31)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a declared table from dicts; missing columns are NULL."""
    from custlattice.sources.schemas import SCHEMAS

    def build(table, *rows):
        schema = SCHEMAS[table]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return build
