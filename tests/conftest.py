"""One local session for all tests, with four partitions: small data, but more than one task."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quaerix.session import local_session, ship

    session = local_session("8", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
