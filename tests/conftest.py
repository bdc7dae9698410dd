import pytest

from logweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    # Small splits, so that even tiny logs are cut into several blocks.
    return local_session(4, shuffle_partitions=4, **{"spark.sql.files.maxPartitionBytes": "4096"})
