from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    s.sparkContext.setLogLevel("OFF")
    return s
