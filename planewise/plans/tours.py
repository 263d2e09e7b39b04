"""Paths of planes: grand tours, guided views and their frames."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.functions.metrics import REGISTRY
from planewise.operators import projection
from planewise.operators.moments import moments, moments_by
from planewise.operators.neighbors import knn_of
from planewise.operators.pairs import pairs, space
from planewise.plans import bases

VALID_KINDS = ("linear_projection", "domain_geodesic")
KINDS = (*VALID_KINDS, "sequential_embedding", "representation_transition", "representation_morph")
COINCIDENT = 0.08
NEAREST = 6


@dataclass
class Path:
    """Keyframes of one kind; only linear projections and domain geodesics have meaningful frames in between."""

    id: str
    kind: str
    keyframes: list[str]
    valid: bool | None = None
    note: str = ""
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of path {self.kind!r}")
        meaningful = self.kind in VALID_KINDS
        if self.valid is None:
            self.valid = meaningful
        elif self.valid and not meaningful:
            raise ValueError(f"frames between those of a {self.kind} mean nothing")


def linear_path(id: str, views: list[tuple[str, str]]) -> Path:
    """A path through (view, representation) keyframes of one representation."""
    if not views:
        raise ValueError("a path needs keyframes")
    if len({r for _, r in views}) > 1:
        raise ValueError("a linear path stays in one representation")
    return Path(id, "linear_projection", [v for v, _ in views])


def morph_path(id: str, views: list[str]) -> Path:
    return Path(id, "representation_morph", views, note="Frames between representations are drawn, not computed.")


def embedding_path(id: str, views: list[str]) -> Path:
    return Path(id, "sequential_embedding", views, note="Frames between embeddings are drawn, not computed.")


def grand_tour_bases(dimension: int, n_frames: int = 180, seed: int = 42) -> list[np.ndarray]:
    """Bases of a closed loop through random planes, frames dealt to segments by their length (two at least)."""
    rng = np.random.default_rng(seed)
    keys = [bases.orthonormalized(rng.standard_normal((dimension, 2))) for _ in range(max(4, n_frames // 30))]
    legs = list(zip(keys, [*keys[1:], keys[0]], strict=True))
    lengths = np.array([bases.grassmann_distance(a, b) for a, b in legs])
    share = lengths / lengths.sum() if lengths.sum() > 0 else np.full(len(legs), 1 / len(legs))
    out = []
    for (a, b), s in zip(legs, share, strict=True):
        n = max(2, round(n_frames * s))
        out += [bases.geodesic(a, b, t / n) for t in range(n)]
    return out


def grand_tour(points: DataFrame, dimension: int, n_frames: int = 180, seed: int = 42, vec: str = "vec") -> DataFrame:
    """(frame, object_id, x, y) of z-scored points, each axis in [-1, 1] over all frames."""
    z = projection.zscore(points, dimension, vec)
    return projection.minmax(projection.frames(z, grand_tour_bases(dimension, n_frames, seed), "z"))


@dataclass
class GuidedView:
    basis: np.ndarray
    bases: list[np.ndarray]
    succeeded: bool
    frames: DataFrame


def guided_view(points: DataFrame, dimension: int, criterion: str, target_id: str | None = None, n_frames: int = 60, label: str = "label", vec: str = "vec") -> GuidedView:
    """A geodesic from the PCA plane to one that separates classes or keeps a target's neighbourhood.

    Where the two planes nearly coincide the path leads to later principal axes and is
    flagged as not succeeded.
    """
    z = projection.zscore(points, dimension, vec)
    whole = moments(z, dimension, "z")
    start = bases.axes(whole.covariance)
    if criterion == "class_separation":
        end = bases.discriminant_plane(moments_by(z, dimension, label, "z"))
    elif criterion == "neighborhood_integrity":
        near = space(z.withColumnRenamed("z", "__z"), "__z", dimension, REGISTRY.get("euclidean"))
        ids = [r[0] for r in knn_of(pairs(near, target_id), NEAREST - 1).select("neighbor_id").collect()]
        end = bases.integrity_plane(moments(z.where(F.col("object_id").isin(target_id, *ids)), dimension, "z"), whole)
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    apart = bases.grassmann_distance(start, end) >= COINCIDENT
    if not apart:
        end = bases.axes(whole.covariance, 2 if dimension >= 4 else 1)
    n = max(2, min(360, n_frames))
    path = [bases.geodesic(start, end, t / (n - 1)) for t in range(n)]
    return GuidedView(end, path, apart, projection.isotropic(projection.frames(z, path, "z")))
