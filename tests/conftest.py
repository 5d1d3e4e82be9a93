import pytest

from cuewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "cuewright-tests", 4)
    yield session
    session.stop()
