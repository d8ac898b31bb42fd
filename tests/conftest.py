import pytest

from kgspark.session import build_session, importable


@pytest.fixture(scope="session")
def spark():
    session = importable(build_session("tests", cpus="4", shuffle_partitions=4))
    session.sparkContext.setLogLevel("ERROR")
    return session
