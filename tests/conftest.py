"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    os.environ["SPARK_LOCAL_DIRS"] = str(folder / "local")
    session = local_session(8, 4, "6g", {"spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": str(folder / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    """The smallest of the driver's table sets."""
    return "/root/testdata/sf0.001"
