import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import local_session

    session = local_session(shuffle_partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Force ordered operators onto the split path."""
    from tapeloom.session import BLOCK_ROWS_CONF

    spark.conf.set(BLOCK_ROWS_CONF, "7")
    yield 7
    spark.conf.unset(BLOCK_ROWS_CONF)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
