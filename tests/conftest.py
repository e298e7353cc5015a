import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larkbeam import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="8g", checkpoint_dir=tempfile.mkdtemp(prefix="larkbeam-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
