import pytest

from dokuma import session


@pytest.fixture(scope="session")
def spark():
    made = session.build(app="tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
