import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomstat.session import get_session
    return get_session(master="local[4]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf():
    return SF
