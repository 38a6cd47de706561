import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import corpus, frame  # noqa: E402

from ridgemark.plans.ship import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
