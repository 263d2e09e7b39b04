"""Rashomon sets: different planes that are about as trustworthy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks
from planewise.operators.diagnostics import rank_penalty_scale
from planewise.operators.moments import moments, moments_by
from planewise.plans import bases

RANDOM_PLANES = 12
APART_DEGREES = 12.0
NEIGHBORS = 5


@dataclass
class Candidate:
    id: str
    title: str
    trustworthiness: float
    grassmann_degrees: float
    basis: np.ndarray


def pool(points: DataFrame, dimension: int, label: str = "label", seed: int = 42, vec: str = "vec") -> list[tuple[str, np.ndarray]]:
    whole = moments(points, dimension, vec)
    classes = moments_by(points, dimension, label, vec)
    found = [("pca_12", bases.axes(whole.covariance))]
    if dimension >= 4:
        found.append(("pca_34", bases.axes(whole.covariance, 2)))
    if len(classes) > 1:
        found.append(("fisher_lda", bases.discriminant_plane(classes)))
    sd = np.sqrt(np.maximum(np.diag(whole.covariance), 1e-16))
    found.append(("covariance", bases.axes(whole.covariance / np.outer(sd, sd))))
    return [*found, *((f"haar_{i:02d}", bases.haar(dimension, 2, seed + i)) for i in range(RANDOM_PLANES))]


def trust_of(points: DataFrame, dimension: int, planes: list[tuple[str, np.ndarray]], k: int = NEIGHBORS, vec: str = "vec") -> dict[str, float]:
    """Trustworthiness of every plane over blocks of points, which are ranked by the source once."""
    metric = REGISTRY.get("euclidean")
    placed = blocks.placed(points, vec, dimension, metric, [])
    n = placed.count()
    if n <= k + 1 or k < 1:
        return {name: 1.0 for name, _ in planes}
    lost = blocks.rank_penalties(placed, dimension, metric, [b for _, b in planes], k, n)
    return {name: float(np.clip(1 - rank_penalty_scale(n, k) * x, 0, 1)) for (name, _), x in zip(planes, lost, strict=True)}


def rashomon_set(points: DataFrame, dimension: int, reference: np.ndarray | None = None, n_candidates: int = 6, threshold: float = 0.5, label: str = "label", seed: int = 42, vec: str = "vec") -> list[Candidate]:
    """Planes of at least ``threshold``, best first, each at least ``APART_DEGREES`` from those taken before."""
    planes = pool(points, dimension, label, seed, vec)
    trust = trust_of(points, dimension, planes, vec=vec)
    reference = planes[0][1] if reference is None else reference
    taken: list[Candidate] = []
    for name, b in sorted(planes, key=lambda p: -trust[p[0]]):
        apart = all(np.degrees(bases.grassmann_distance(b, t.basis)) >= APART_DEGREES for t in taken)
        if trust[name] >= threshold and apart and len(taken) < n_candidates:
            taken.append(Candidate(name, name.replace("_", " "), round(trust[name], 4), round(float(np.degrees(bases.grassmann_distance(reference, b))), 2), b))
    return taken
