import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txlens import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", 8, "8g")
    yield s
