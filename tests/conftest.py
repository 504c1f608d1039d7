import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from regtext.session import build_session
    s = build_session("local[4]", app="regtext-tests", shuffle_partitions=4)
    yield s
    s.stop()
