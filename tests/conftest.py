import pytest

from opsweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(app="opsweave-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
