import pytest

from granary.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    return found
