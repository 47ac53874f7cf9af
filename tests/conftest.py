import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from intervale.session import prepare, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    prepare(s)
    return s
