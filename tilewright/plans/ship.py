"""Sends the package to the executors' Python workers.

Operators run functions of this package in the workers.  Where the workers
find it by ``PYTHONPATH`` nothing is sent; else its sources go along once
per application, as ``--py-files`` would send them.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tilewright-py-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)  # Spark's own file server hands it to every executor
