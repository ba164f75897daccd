import pytest

from lorefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "lorefold-tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    from lorefold.sources.tables import ship_package

    ship_package(session)
    yield session
    session.stop()
