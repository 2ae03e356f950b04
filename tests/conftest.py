from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cashlens.session import get_session

    session = get_session(4, shuffle_partitions=4)
    yield session
    session.stop()
