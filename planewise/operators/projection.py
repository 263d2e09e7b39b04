"""Linear projections and normalisations; bases are small driver arrays spliced in as literals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.conventions import MIN_SPREAD
from planewise.operators.neighbors import result


def along(vec: Column, axis: np.ndarray, centre: np.ndarray | None = None) -> Column:
    """The coordinate of a vector on one axis: terms of zero weight aren't computed."""
    terms = [(vec[k] - float(centre[k]) if centre is not None else vec[k]) * float(w) for k, w in enumerate(axis) if w]
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def along_named(vec: str, axis: np.ndarray) -> Column:
    """The same for a column's name, as one SQL text: many planes are built in little time."""
    terms = [f"`{vec}`[{k}] * {float(w)!r}D" for k, w in enumerate(axis) if w]
    return F.expr(" + ".join(terms) or "0D")


def project(points: DataFrame, basis: np.ndarray, vec: str = "vec", centre: np.ndarray | None = None) -> DataFrame:
    """``points`` with ``x`` and ``y`` on the columns of a K x 2 basis, about ``centre`` if given."""
    return points.withColumn("x", along(F.col(vec), basis[:, 0], centre)).withColumn("y", along(F.col(vec), basis[:, 1], centre))


def column_means(points: DataFrame, dimension: int, vec: str = "vec") -> np.ndarray:
    row = points.agg(*(F.avg(F.col(vec)[k]) for k in range(dimension))).first()
    return np.array([v if v is not None else 0.0 for v in row])


def zscore(points: DataFrame, dimension: int, vec: str = "vec") -> DataFrame:
    """``z``: each feature less its mean over its population deviation; a deviation under ``MIN_SPREAD`` counts as 1."""
    parts = [f(F.col(vec)[k]) for k in range(dimension) for f in (F.avg, F.stddev_pop)]
    row = points.agg(*parts).first()
    mean, sd = row[0::2], [s if s is not None and s >= MIN_SPREAD else 1.0 for s in row[1::2]]
    return points.withColumn("z", F.array(*((F.col(vec)[k] - F.lit(mean[k])) / F.lit(sd[k]) for k in range(dimension))))


def _unit(c: str, low: float, high: float) -> Column:
    return F.lit(0.0) if high <= low else 2.0 * (F.col(c) - F.lit(low)) / F.lit(high - low) - 1.0


def minmax(points: DataFrame) -> DataFrame:
    """``x`` and ``y``, each to [-1, 1] over all rows (all frames of a tour at once)."""
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if r[0] is None:
        return points
    return points.withColumn("x", _unit("x", r[0], r[1])).withColumn("y", _unit("y", r[2], r[3]))


def minmax_each(framed: DataFrame) -> DataFrame:
    """``x`` and ``y`` of (frame, object_id, x, y), each to [-1, 1] within its frame; frames are few, so their ranges are broadcast."""
    ranges = framed.groupBy("frame").agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max))))
    unit = lambda c: F.when(F.col(f"{c}1") <= F.col(f"{c}0"), 0.0).otherwise(2.0 * (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) - 1.0).alias(c)
    return framed.join(F.broadcast(ranges), "frame").select("frame", "object_id", unit("x"), unit("y"))


def isotropic(points: DataFrame) -> DataFrame:
    """``x`` and ``y`` about the middle of their ranges over half the greater range."""
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if r[0] is None:
        return points
    half = max(r[1] - r[0], r[3] - r[2]) / 2 or 1.0
    return points.withColumn("x", (F.col("x") - (r[0] + r[1]) / 2) / half).withColumn("y", (F.col("y") - (r[2] + r[3]) / 2) / half)


def frames(points: DataFrame, bases: list[np.ndarray], vec: str = "vec") -> DataFrame:
    """(frame, object_id, x, y) of a tour: every point under every basis, the bases as one literal a row is mapped over."""
    k = bases[0].shape[0]
    weights = F.array(*(F.array(*(F.lit(float(w)) for w in np.concatenate([b[:, 0], b[:, 1]]))) for b in bases))
    dots = lambda w, at: F.aggregate(F.zip_with(F.slice(w, at, k), F.col(vec), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = points.select("object_id", vec, F.posexplode(weights).alias("frame", "w"))
    return each.select("frame", "object_id", dots(F.col("w"), 1).alias("x"), dots(F.col("w"), k + 1).alias("y"))


def loadings(basis: np.ndarray, names: list[str], top: int = 4) -> list[tuple[str, float]]:
    """Features by the length of their two weights, the longest first, ties by name."""
    size = np.hypot(basis[:, 0], basis[:, 1])
    return sorted(zip(names, map(float, size), strict=True), key=lambda p: (-round(p[1], 9), p[0]))[:top]


def variance_share(eigenvalues: np.ndarray) -> float:
    """The first axis' share of the two axes' variance."""
    both = float(eigenvalues[0] + eigenvalues[1])
    return float(eigenvalues[0]) / both if both > 0 else 0.0


def rounded(points: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        points = points.withColumn(c, result(F.col(c)))
    return points
