import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Every size check fails: the ways for large inputs run."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
