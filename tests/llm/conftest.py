import pytest


@pytest.fixture(scope="session")
def spark():
    from servebench.session import get_session

    return get_session("local[4]", shuffle_partitions=4)
