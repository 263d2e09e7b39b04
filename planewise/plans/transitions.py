"""Frames between two tables of the same objects: geodesics of beliefs, and aligned morphs of planes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Square roots of two beliefs nearer than this angle are one direction.
SAME = 1e-8


def _steps(frames: int) -> list[float]:
    if frames < 2:
        raise ValueError("a transition has two frames at least")
    return [t / (frames - 1) for t in range(frames)]


def domain_geodesic(start: DataFrame, end: DataFrame, frames: int, vec: str = "vec") -> DataFrame:
    """(frame, object_id, vec): beliefs on the shortest path under the Fisher-Rao metric, for objects in both tables.

    Square roots of beliefs lie on a sphere, where the path is an arc of a great circle;
    every frame's entries sum to 1.  The first frame is ``start`` and the last ``end``.
    """
    steps = _steps(frames)
    roots = lambda df, name: df.where(F.col(vec).isNotNull()).select("object_id", F.transform(vec, F.sqrt).alias(name))
    both = roots(start, "p").join(roots(end, "q"), "object_id")
    angle = F.acos(F.least(F.lit(1.0), F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    each = both.withColumn("angle", angle).select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("frame", "tau"))
    sine = F.sin("angle")
    apart = F.col("angle") > SAME
    weight = lambda t: F.when(apart, F.sin(t * F.col("angle")) / sine).otherwise(t)
    weighed = each.select("frame", "object_id", "p", "q", weight(1.0 - F.col("tau")).alias("a"), weight(F.col("tau")).alias("b"))
    return weighed.select("frame", "object_id", F.zip_with("p", "q", lambda x, y: (F.col("a") * x + F.col("b") * y) * (F.col("a") * x + F.col("b") * y)).alias("vec"))


def procrustes(start: DataFrame, end: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 2 x 2 map (scale times rotation or reflection) that lays ``end`` on ``start`` (object_id, x, y), and both centres.

    One aggregate gives the means and cross moments of the objects in both; nine numbers reach the driver.
    """
    both = start.select("object_id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(end.select("object_id", F.col("x").alias("bx"), F.col("y").alias("by")), "object_id")
    cross = [F.covar_pop(b, a) for b in ("bx", "by") for a in ("ax", "ay")]
    r = both.agg(*(F.avg(c) for c in ("ax", "ay", "bx", "by")), *cross, F.var_pop("bx") + F.var_pop("by")).first()
    if r[0] is None:
        return np.eye(2), np.zeros(2), np.zeros(2)
    u, sizes, vt = np.linalg.svd(np.array(r[4:8]).reshape(2, 2))
    scale = sizes.sum() / r[8] if r[8] > 0 else 1.0
    return scale * (u @ vt).T, np.array(r[0:2]), np.array(r[2:4])


def procrustes_morph(start: DataFrame, end: DataFrame, frames: int) -> DataFrame:
    """(frame, object_id, x, y, valid): straight lines from ``start`` to ``end`` laid on it as well as scale, rotation and reflection can.

    The planes belong to different representations, so no frame in between is a projection: ``valid`` is false.
    """
    steps = _steps(frames)
    m, a, b = procrustes(start, end)
    both = start.select("object_id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(end.select("object_id", (F.col("x") - float(b[0])).alias("bx"), (F.col("y") - float(b[1])).alias("by")), "object_id")
    laid = lambda k: float(a[k]) + float(m[k, 0]) * F.col("bx") + float(m[k, 1]) * F.col("by")
    each = both.select("object_id", "ax", "ay", laid(0).alias("bx"), laid(1).alias("by"), F.posexplode(F.array(*map(F.lit, steps))).alias("frame", "tau"))
    between = lambda c: ((1.0 - F.col("tau")) * F.col(f"a{c}") + F.col("tau") * F.col(f"b{c}")).alias(c)
    return each.select("frame", "object_id", between("x"), between("y"), F.lit(False).alias("valid"))
