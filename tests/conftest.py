import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from actlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="actlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_uri(tmp_path):
    return str(tmp_path)
