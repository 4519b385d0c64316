import pytest

from litscreen.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g", app="litscreen-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
