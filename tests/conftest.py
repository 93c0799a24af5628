import os

import pytest

from parcelwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "tests")
