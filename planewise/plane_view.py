"""What a renderer needs of a plane: points, a selection and a basis, each checked when it is set."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.operators import projection
from planewise.operators.selection import constraint_counts, duplicate_ids
from planewise.plans.bases import validate_orthonormal


class PlaneView:
    """The state of one drawing; ``frame`` is what to draw."""

    def __init__(self) -> None:
        self._points: DataFrame | None = None
        self._dimension = 0
        self._selected: list[str] = []
        self._basis: np.ndarray | None = None

    def load(self, points: DataFrame, vec: str = "vec") -> None:
        """Points (object_id, vector); TypeError for ids that aren't strings or vectors that aren't numbers.

        ValueError unless ids are unique and not empty and vectors finite, of one length
        of two at least.  A selection and a basis set before are dropped.
        """
        kinds = dict(points.dtypes)
        if kinds.get("object_id") != "string":
            raise TypeError("ids must be strings")
        if kinds.get(vec) not in ("array<double>", "array<float>"):
            raise TypeError("vectors must be arrays of numbers")
        read = points.select("object_id", F.col(vec).cast("array<double>").alias("vec"))
        nameless, least, most = read.agg(F.count_if(F.coalesce(F.trim("object_id") == "", F.lit(True))), F.min(F.coalesce(F.size("vec"), F.lit(0))), F.max(F.size("vec"))).first()
        if nameless or not duplicate_ids(read).isEmpty():
            raise ValueError("ids must be unique and not empty")
        if least is None or least != most or least < 2:
            raise ValueError("vectors must have one length, two at least")
        if constraint_counts(read).first()["finite"]:
            raise ValueError("vectors must be finite")
        self._points, self._dimension, self._selected, self._basis = read, int(least), [], None

    def set_selection(self, object_ids: Iterable[str]) -> None:
        """ValueError where an id isn't loaded.  A selection is small: what a person marks."""
        wanted = sorted(set(object_ids))
        known = self._loaded().where(F.col("object_id").isin(wanted)).count() if wanted else 0
        if known != len(wanted):
            raise ValueError(f"{len(wanted) - known} ids aren't loaded")
        self._selected = wanted

    def set_basis(self, basis: np.ndarray | None) -> None:
        """A K x 2 orthonormal basis for the loaded vectors; none while what is shown isn't a linear projection."""
        if basis is not None:
            self._loaded()
            basis = validate_orthonormal(basis)
            if basis.shape != (self._dimension, 2):
                raise ValueError(f"the basis must be {self._dimension} x 2, not {basis.shape}")
        self._basis = basis

    def current_basis(self) -> np.ndarray | None:
        return None if self._basis is None else self._basis.copy()

    def frame(self) -> DataFrame:
        """(object_id, x, y, selected)."""
        if self._basis is None:
            raise ValueError("no basis is set")
        placed = projection.project(self._loaded(), self._basis)
        return placed.select("object_id", "x", "y", F.col("object_id").isin(self._selected).alias("selected") if self._selected else F.lit(False).alias("selected"))

    def _loaded(self) -> DataFrame:
        if self._points is None:
            raise ValueError("no points are loaded")
        return self._points
