import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathlore.operators import core  # noqa: E402
from pathlore.sources.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(params=["plain", "blocks"])
def strategy(request, monkeypatch):
    """Every test that asks for it runs once with key-wide windows and once split into blocks of 4 rows."""
    if request.param == "blocks":
        monkeypatch.setattr(core, "MAX_ROWS", 4)
    return request.param
