import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stayframe.session import ensure_checkpoints, local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ensure_checkpoints(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def listings(spark):
    from stayframe.sources.listings import load_listings

    return load_listings(spark, SF_DIR)


@pytest.fixture()
def plan():
    """The physical plan of a frame, as text."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
