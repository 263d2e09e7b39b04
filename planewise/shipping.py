"""Sends this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "planewise.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, so that they need no installation."""
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED) == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    staged = os.path.join(tempfile.mkdtemp(prefix="planewise-"), f"{root.name}.zip")  # read by the driver's file server only
    with zipfile.ZipFile(staged, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(staged)
    context.setLocalProperty(_SHIPPED, context.applicationId)
