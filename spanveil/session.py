"""Sessions that suit the library, and its code on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give workers that cannot import the package a copy of its code, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # The driver serves the file to executors as long as it lives.
    folder = tempfile.mkdtemp(prefix="spanveil-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/spanveil-{app}.zip", "w") as z:
        for f in [*(ROOT / "spanveil").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(f"{folder}/spanveil-{app}.zip")


def local(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
