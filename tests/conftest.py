import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import connect  # noqa: E402
from tillwork.session import local_session  # noqa: E402
from tillwork.sources.starschema import Shop  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def shop(spark):
    return Shop(spark, FOLDER)


@pytest.fixture(scope="session")
def con():
    return connect(FOLDER)
