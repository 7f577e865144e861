import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voltlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "voltlake-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows to a DataFrame: make("a int, b string", [(1, "x")])."""
    return lambda layout, rows: spark.createDataFrame(rows, layout)


def at(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)
