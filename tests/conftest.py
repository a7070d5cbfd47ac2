import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wirefold.session import get_session

    s = get_session("local[4]", app="wirefold-tests", shuffle_partitions=8)
    yield s
    s.stop()
