import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spindrel.session import local_session

    session = local_session(4, **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.driver.memory": "4g",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
