"""Sends this package to the executors, once a session, where their Python path lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in on_path or app in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="mediafold-"), "mediafold.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.joinpath("mediafold").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
