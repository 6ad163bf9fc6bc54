import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from spanloom.session import local_session

    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
