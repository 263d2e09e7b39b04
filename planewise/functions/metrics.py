"""Pair metrics and their registry.

A metric prepares each vector once (square root, centred log ratio) and combines two
rows' scalar columns by an unrolled expression that stays in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from planewise.conventions import FISHER_RAO_SCALE
from planewise.errors import CompatibilityError
from planewise.functions import vectors

Combine = Callable[[Sequence[Column], Sequence[Column]], Column]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return _sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared(a, b))


def hellinger_of_roots(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.least(F.sqrt(squared(a, b)) / math.sqrt(2.0), F.lit(1.0))


def _affinity(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.least(F.greatest(_sum([x * y for x, y in zip(a, b, strict=True)]), F.lit(-1.0)), F.lit(1.0))


def fisher_rao_of_roots(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return FISHER_RAO_SCALE * F.acos(_affinity(a, b))


def bhattacharyya_of_roots(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.acos(_affinity(a, b))


def own_entropy(x: Column) -> Column:
    """What an entry alone gives to the divergence; taken once a row, it leaves a pair one logarithm for each entry."""
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def jensen_shannon(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """By entropies, as ``jensen_shannon_block``: entries, then ``own_entropy`` of each. Of equal vectors it is 0 exactly; ``F.log2`` would take two logarithms."""

    def parted(x: Column, y: Column, own: Column) -> Column:
        both = x + y
        return own - F.when(both > 0, both * F.ln(both / 2.0)).otherwise(both * 0.0)

    n = len(a) // 2
    s = _sum([parted(x, y, p + q) for x, y, p, q in zip(a[:n], b[:n], a[n:], b[n:], strict=True)]) * (0.5 / math.log(2.0))
    return F.least(F.sqrt(F.greatest(s, F.lit(0.0))), F.lit(1.0))


# The same over blocks of points: entries of the left ones as columns, of the right ones as rows; terms are added in the same order.
Block = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(np.add, parts)


def euclidean_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.sqrt(_summed([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def hellinger_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.minimum(euclidean_block(a, b) / math.sqrt(2.0), 1.0)


def bhattacharyya_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.arccos(np.clip(_summed([x * y for x, y in zip(a, b, strict=True)]), -1.0, 1.0))


def fisher_rao_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return FISHER_RAO_SCALE * bhattacharyya_block(a, b)


def jensen_shannon_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """By entropies, with one logarithm for each entry of a pair; of equal vectors it is 0 exactly."""
    log = lambda x: np.log2(np.maximum(x, np.finfo(float).tiny))
    s = _summed([0.5 * ((x * log(x) + y * log(y)) - (t := x + y) * log(t / 2.0)) for x, y in zip(a, b, strict=True)])
    return np.minimum(np.sqrt(np.maximum(s, 0.0)), 1.0)


@dataclass(frozen=True)
class Key:
    """A number in whose order the distances stand and that a matrix product gives: the squared distance of prepared vectors, or less their dot product (``dot``)."""

    dot: bool
    of: Callable[[np.ndarray], np.ndarray]
    distance: Callable[[np.ndarray], np.ndarray]


SQUARE = Key(False, lambda d: d * d, lambda s: np.sqrt(np.maximum(s, 0.0)))
HALF_SQUARE = Key(False, lambda d: np.where(d >= 1.0, np.inf, 2.0 * d * d), lambda s: np.minimum(np.sqrt(np.maximum(s, 0.0) / 2.0), 1.0))


def _angle(s: np.ndarray) -> np.ndarray:
    out = np.negative(s)
    np.minimum(out, 1.0, out=out)
    np.maximum(out, -1.0, out=out)
    return np.arccos(out, out=out)


ANGLE = Key(True, lambda d: np.where(d >= math.pi, np.inf, -np.cos(d)), _angle)
SCALED_ANGLE = Key(True, lambda d: ANGLE.of(d / FISHER_RAO_SCALE), lambda s: FISHER_RAO_SCALE * ANGLE.distance(s))


@dataclass(frozen=True)
class Metric:
    """``prepare`` maps a vector once a row; ``combine`` maps two rows' prepared entries to a distance, ``block`` those of two blocks; ``key`` is its key, if it has one; ``term``, if it has one, is a number of each prepared entry that ``combine`` takes behind all entries."""

    id: str
    representations: tuple[str, ...]
    combine: Combine
    block: Block | None = None
    prepare: Callable[[Column], Column] = lambda v: v
    is_metric: bool = True
    units: str = ""
    key: Key | None = None
    term: Callable[[Column], Column] | None = None


PROBABILITY = "probability"
REPRESENTATIONS = (PROBABILITY, "sqrt_probability", "clr_probability", "logit")


class MetricRegistry:
    """Metrics by id with the representations each may be used on; open to further ones."""

    def __init__(self) -> None:
        self._held: dict[str, Metric] = {}
        for m in (
            Metric("euclidean", REPRESENTATIONS, euclidean, euclidean_block, key=SQUARE),
            Metric("hellinger", (PROBABILITY,), hellinger_of_roots, hellinger_block, vectors.sqrt_probability, units="0..1", key=HALF_SQUARE),
            Metric("fisher_rao", (PROBABILITY,), fisher_rao_of_roots, fisher_rao_block, vectors.sqrt_probability, units="radians, 0..pi", key=SCALED_ANGLE),
            Metric("aitchison", (PROBABILITY,), euclidean, euclidean_block, vectors.clr, key=SQUARE),
            Metric("jensen_shannon", (PROBABILITY,), jensen_shannon, jensen_shannon_block, units="sqrt bits, 0..1", term=own_entropy),
            Metric("bhattacharyya", (PROBABILITY,), bhattacharyya_of_roots, bhattacharyya_block, vectors.sqrt_probability, units="radians, 0..pi/2", key=ANGLE),
        ):
            self.register(m)

    def register(self, metric: Metric) -> None:
        self._held[metric.id] = metric

    def ids(self) -> list[str]:
        return list(self._held)

    def get(self, id: str) -> Metric:
        """KeyError for an unknown id."""
        if id not in self._held:
            raise KeyError(f"unknown metric {id!r}; there are {', '.join(self._held)}")
        return self._held[id]

    def compatible(self, id: str, representation: str) -> Metric:
        """The metric, if it may be used on the representation (``logits`` is another name of ``logit``)."""
        metric, name = self.get(id), {"logits": "logit"}.get(representation, representation)
        if name not in metric.representations:
            raise CompatibilityError(f"{id} isn't defined on {representation}; it takes {', '.join(metric.representations)}")
        return metric


REGISTRY = MetricRegistry()


def represent(representation: str) -> Callable[[Column], Column]:
    """The transform from probabilities to a representation."""
    return {PROBABILITY: lambda v: v, "sqrt_probability": vectors.sqrt_probability, "clr_probability": vectors.clr, "logit": vectors.logit, "logits": vectors.logit}[representation]
