import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loreloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g", name="tests")


@pytest.fixture(scope="session")
def as_of():
    from pyspark.sql import functions as F

    return F.timestamp_seconds(F.lit(1_750_000_000))
