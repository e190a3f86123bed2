import pytest

from evigraph.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", spark__sql__shuffle__partitions="3", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
