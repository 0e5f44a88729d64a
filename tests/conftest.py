import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagwright.session import local_session

    s = local_session(cpus="4", partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(expr..., rows, schema): rows of the evaluated columns."""

    def run(columns, rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in df.select(*columns).collect()]

    return run
