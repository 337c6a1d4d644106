import pytest

from dwellspark.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
