import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veilframe.session import build_session

    # the checkpoint folder comes from the configuration when set; otherwise
    # veilframe.session registers a scratch folder of its own
    s = build_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()
