"""Small fixed worlds with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# The calibration simplex, in order.
CALIBRATION = (
    ("corner_0", (1.0, 0.0, 0.0)), ("corner_1", (0.0, 1.0, 0.0)), ("corner_2", (0.0, 0.0, 1.0)),
    ("midpoint_01", (0.5, 0.5, 0.0)), ("midpoint_02", (0.5, 0.0, 0.5)), ("midpoint_12", (0.0, 0.5, 0.5)),
    ("center", (1 / 3, 1 / 3, 1 / 3)),
    ("interior_00", (0.7, 0.2, 0.1)), ("interior_01", (0.1, 0.7, 0.2)), ("interior_02", (0.2, 0.1, 0.7)), ("interior_03", (0.6, 0.3, 0.1)),
    ("interior_04", (0.1, 0.6, 0.3)), ("interior_05", (0.3, 0.1, 0.6)), ("interior_06", (0.4, 0.4, 0.2)), ("interior_07", (0.2, 0.4, 0.4)),
)
#: Points that a view without z brings together or keeps apart.
DECEPTION = (("t", (0.0, 0.0, 0.0)), ("a", (0.1, 0.0, 0.0)), ("b", (0.5, 0.0, 0.0)), ("f", (0.2, 0.0, 5.0)), ("g", (3.0, 0.0, 0.0)), ("h", (0.0, 4.0, 0.0)))

SCHEMA = "object_id string, pos long, label string, vec array<double>"


def calibration(spark: SparkSession) -> DataFrame:
    """The 15 points of the simplex; labels are argmax classes, the centre is ambiguous."""
    rows = [(n, i, "ambiguous" if n == "center" else f"class_{int(np.argmax(v))}", list(v)) for i, (n, v) in enumerate(CALIBRATION)]
    return spark.createDataFrame(rows, SCHEMA)


def deception(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, None, list(v)) for i, (n, v) in enumerate(DECEPTION)], SCHEMA)


def orthogonal_planes() -> dict[str, np.ndarray]:
    """Planes in four dimensions: F2 is F1 turned by 60 degrees within itself, F3 is orthogonal, F4 shares one axis."""
    e, t = np.eye(4), np.radians(60)
    f1 = e[:, [0, 1]]
    return {"F1": f1, "F2": f1 @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]), "F3": e[:, [2, 3]], "F4": e[:, [0, 2]]}
