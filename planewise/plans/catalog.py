"""The catalogue of named views of a representation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.functions.vectors import argmax
from planewise.operators.moments import Moments, moments, moments_by
from planewise.plans import bases


@dataclass(frozen=True)
class CatalogView:
    view_id: str
    basis: np.ndarray
    title: str
    misleading: bool = False
    valid: bool = True


def catalog(points: DataFrame, dimension: int, vec: str = "vec") -> dict[str, CatalogView]:
    """Corner PCA, minor PCA (from four features), Fisher LDA on argmax classes (from three), collapsed bridge, entropy plane."""
    whole = moments(points, dimension, vec)
    classes: dict[str, Moments] = moments_by(points.withColumn("__class", argmax(F.col(vec))), dimension, "__class", vec) if dimension >= 3 else {}
    found = [CatalogView("pca_corners", bases.pca(whole)[0], "Corners: principal components 1 and 2")]
    if dimension >= 4:
        found.append(CatalogView("minor_pca", bases.axes(whole.covariance, 2), "Minor variation: principal components 3 and 4"))
    if dimension >= 3:
        found.append(CatalogView("fisher_lda", bases.discriminant_plane(classes), "Classes apart: Fisher's plane"))
    found.append(CatalogView("collapsed_bridge", bases.bridge_plane(dimension), "Classes merged on purpose", misleading=True))
    found.append(CatalogView("entropy", bases.entropy_plane(whole), "Spread about the uniform centre"))
    return {v.view_id: v for v in found}
