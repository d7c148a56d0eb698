"""One local session for all tests."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from corvane.session import local_session

    s = local_session("4", 4, **{"spark.ui.showConsoleProgress": "false", "driver_memory": "3g"})
    yield s
    s.stop()
