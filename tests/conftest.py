"""One small local session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from siltwork.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = local_session(cpus=4, partitions=4, memory="3g")
    yield session
    session.stop()
