import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("LODESTRATA_DRIVER_MEMORY", "4g")
    from lodestrata.session import local_session, ship

    session = local_session(4, "tests")
    ship(session)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
