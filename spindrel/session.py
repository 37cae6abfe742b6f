"""Sessions, and the way the package reaches Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, as tests and bench.py use it."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("spindrel")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it by themselves.

    Where PYTHONPATH or the working folder has it, nothing is sent.
    """
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p, _ROOT.name).resolve() == _ROOT for p in places):
        return
    path = Path(tempfile.mkdtemp(prefix="spindrel-code-"), "spindrel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in _ROOT.rglob("*.py"):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
