import pytest

from graphmill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", shuffle_partitions=4)
    ship(session)
    return session
