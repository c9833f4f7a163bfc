import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corvane.session import local_session

    session = local_session("8", 8, "corvane-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not TESTDATA.exists():
        pytest.skip("no test tables here")
    return str(TESTDATA)
