from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session

    session = build_session("ledgerloom-tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a small literal table as dictionaries after a transformation."""

    def run(data, ddl, fn):
        return [r.asDict(recursive=True) for r in fn(spark.createDataFrame(data, ddl)).collect()]

    return run
