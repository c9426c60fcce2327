import pytest

from sievelake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "sievelake-tests")
    yield session
    session.stop()
