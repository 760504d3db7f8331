import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rulefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        4,
        "tests",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield session
    session.stop()


@pytest.fixture(scope="module")
def small_state(spark):
    """Two parts of state, as each is opened in every micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
