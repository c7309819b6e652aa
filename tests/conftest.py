"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from sparkwell.session import build_session

    session = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
