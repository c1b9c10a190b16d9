import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tallyroom.session import session

    s = session("tests", master="local[8]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def hot_keys(spark):
    """Treat every key with more than two rows as hot, so salted paths run."""
    spark.conf.set("spark.tallyroom.hotRows", "2")
    yield
    spark.conf.unset("spark.tallyroom.hotRows")
