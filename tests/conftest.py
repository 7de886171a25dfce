import pytest

from blockloom.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "blockloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    prepare(session)
    return session
