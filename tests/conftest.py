"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(
        "8", 4, **{"spark.driver.memory": "6g", "spark.local.dir": str(folder / "local"), "spark.checkpoint.dir": f"file://{folder}/checkpoint", "spark.ui.showConsoleProgress": "false"}
    )
    yield session
    session.stop()
