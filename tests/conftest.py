import pytest

from tradeloom.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
