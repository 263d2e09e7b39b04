"""Orthonormal K x 2 bases and subspace geometry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from planewise.conventions import FITTED_ORTHONORMAL_ATOL, IMPORTED_ORTHONORMAL_ATOL
from planewise.errors import CompatibilityError
from planewise.operators.moments import Moments, scatter_between, scatter_within

RIDGE = 1e-4


def validate_orthonormal(basis: np.ndarray, atol: float = IMPORTED_ORTHONORMAL_ATOL) -> np.ndarray:
    """The basis, if it is K x d with K >= d and orthonormal columns."""
    b = np.asarray(basis, float)
    if b.ndim != 2 or b.shape[0] < b.shape[1]:
        raise ValueError(f"a basis is K x d with K >= d, not {b.shape}")
    if not np.allclose(b.T @ b, np.eye(b.shape[1]), rtol=0, atol=atol):
        raise ValueError("the columns aren't orthonormal")
    return b


def canonical(basis: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive; the first one decides ties."""
    top = np.abs(basis).argmax(axis=0)
    signs = np.sign(basis[top, np.arange(basis.shape[1])])
    return basis * np.where(signs == 0, 1.0, signs)


def orthonormalized(vectors: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(vectors)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and their vectors."""
    values, vecs = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0.0), vecs[:, order]


def axes(scatter: np.ndarray, first: int = 0) -> np.ndarray:
    """The canonical plane of two consecutive principal axes."""
    _, vecs = principal(scatter)
    if vecs.shape[1] < first + 2:
        raise ValueError(f"{vecs.shape[1]} features have no principal axes {first + 1} and {first + 2}")
    return canonical(vecs[:, first : first + 2])


def pca(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Plane and eigenvalues of the mean-centred, unscaled principal components 1 and 2."""
    if m.n < 2:
        raise ValueError("principal components need two rows")
    values, _ = principal(m.covariance)
    return validate_orthonormal(axes(m.covariance), FITTED_ORTHONORMAL_ATOL), values


def entropy_plane(m: Moments) -> np.ndarray:
    """Principal axes 2 and 3 about the uniform centre; 1 and 2 if there are fewer."""
    k = len(m.mean)
    return axes(m.about(np.full(k, 1.0 / k)), 1 if k >= 3 else 0)


def bridge_plane(k: int, seed: int = 42) -> np.ndarray:
    """A plane that merges classes on purpose: the first two, and of four also the last two, fall together."""
    b = np.zeros((k, 2))
    if k == 3:
        b[[0, 1], 0], b[2, 1] = np.sqrt(0.5), 1.0
    elif k == 4:
        b[[0, 1], 0] = b[[2, 3], 1] = np.sqrt(0.5)
    else:
        b = orthonormalized(np.random.default_rng(seed).standard_normal((k, 2)))
    return b


def discriminant_plane(classes: dict[str, Moments], ridge: float = RIDGE) -> np.ndarray:
    """Fisher's plane in the symmetric form: whiten by the within scatter, take the between scatter's axes, map back.

    Fewer than two classes leave principal components.  Two classes leave the second axis free.
    """
    whole = Moments(sum(m.n for m in classes.values()), np.zeros(1), scatter_within(classes) + scatter_between(classes))
    if len(classes) < 2:
        return axes(whole.scatter)
    within = scatter_within(classes)
    values, vecs = np.linalg.eigh(within + ridge * np.eye(len(within)))
    root = vecs @ np.diag(1.0 / np.sqrt(np.maximum(values, 1e-300))) @ vecs.T
    _, best = principal(root @ scatter_between(classes) @ root)
    return canonical(orthonormalized(root @ best[:, :2]))


def integrity_plane(subset: Moments, whole: Moments) -> np.ndarray:
    """Principal plane of a subset about its own mean; about the global mean for one row; the global one for none."""
    k = len(whole.mean)
    if subset.n == 0:
        return axes(whole.scatter) if whole.n >= 2 else np.eye(k)[:, :2]
    return axes(subset.about(whole.mean) if subset.n == 1 else subset.scatter)


def haar(k: int, d: int = 2, seed: int = 42) -> np.ndarray:
    """A uniformly random d-plane."""
    return orthonormalized(np.random.default_rng(seed).standard_normal((k, d)))


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between two planes in radians, ascending."""
    qa, qb = orthonormalized(a), orthonormalized(b)
    cos = np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0.0, 1.0)
    sin = np.clip(np.linalg.svd(qb - qa @ (qa.T @ qb), compute_uv=False), 0.0, 1.0)[::-1]
    # Small angles lose their digits in the cosine and large ones in the sine.
    return np.where(cos > np.sqrt(0.5), np.arcsin(sin), np.arccos(cos))


def grassmann_distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt((principal_angles(a, b) ** 2).sum()))


def geodesic(a: np.ndarray, b: np.ndarray, tau: float, continuous: bool = False) -> np.ndarray:
    """The basis at ``tau`` on the shortest path of planes from ``a`` to ``b``; the ends are ``a`` and ``b`` themselves.

    The path's own limits are ``a`` and ``b`` turned within their planes.  With
    ``continuous`` inner frames are turned back, so that they begin at ``a`` as given.
    """
    if tau <= 0:
        return a.copy()
    if tau >= 1:
        return b.copy()
    u, cos, vt = np.linalg.svd(a.T @ b)
    start, end = a @ u, b @ vt.T
    angle = np.arccos(np.clip(cos, -1.0, 1.0))
    sin = np.sin(angle)
    towards = np.where(sin > 1e-8, (end - start * np.cos(angle)) / np.where(sin > 1e-8, sin, 1.0), 0.0)
    out = orthonormalized(start * np.cos(tau * angle) + towards * np.sin(tau * angle))
    return out @ u.T if continuous else out


def text_hash(items: Iterable[str]) -> str:
    """SHA-256 of items each followed by NUL, in order."""
    h = hashlib.sha256()
    for x in items:
        h.update(x.encode() + b"\0")
    return h.hexdigest()


@dataclass
class FittedView:
    """A plane with what it was fitted on."""

    view_id: str
    representation: str
    basis: np.ndarray
    feature_names: list[str]
    object_id_hash: str = ""
    eigenvalues: list[float] = field(default_factory=list)
    centering: str = "mean_centered"
    scaling: str = "unscaled"
    component_indices: tuple[int, int] = (0, 1)
    implementation_version: str = "0.1.0"

    @property
    def feature_hash(self) -> str:
        return text_hash(self.feature_names)

    def check(self, representation: str, features: list[str], object_id_hash: str | None = None) -> None:
        """CompatibilityError unless the view belongs to this representation, these features and these objects."""
        if representation != self.representation:
            raise CompatibilityError(f"{self.view_id} was fitted on {self.representation}")
        if len(features) != self.basis.shape[0] or text_hash(features) != self.feature_hash:
            raise CompatibilityError(f"{self.view_id} has other features")
        if object_id_hash is not None and object_id_hash != self.object_id_hash:
            raise CompatibilityError(f"{self.view_id} was fitted on other objects")
