import pytest

from tallyframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()
