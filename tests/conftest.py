import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tern.session import build_session, checkpoint_dir

    s = build_session("local[4]", app_name="tern-tests", shuffle_partitions=8, driver_memory="8g")
    checkpoint_dir(s)  # tests: set a local one only because none is configured
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="tern-test-")
