import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    rows = [("Alice", 30, "a@example.com"), ("Bob", 25, "b@example.com"), ("Charlie", -5, "invalid")]
    return spark.createDataFrame(rows, "name string, age bigint, email string")
