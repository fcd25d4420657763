import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from twin import SMALL, connect, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def twins():
    return connect(SMALL)
