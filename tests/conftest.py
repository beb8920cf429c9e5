import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from churnframe.session import local_session

    s = local_session("*", 8, app="churnframe-tests")
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="churnframe-test-", dir="/tmp")
