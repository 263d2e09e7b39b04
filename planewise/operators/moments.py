"""First and second moments in one pass with partial products a partition; only K x K numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.shipping import ship


@dataclass
class Moments:
    """Rows, mean and central scatter (sum of outer products) of vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    def about(self, centre: np.ndarray) -> np.ndarray:
        """Scatter about another centre."""
        d = self.mean - centre
        return self.scatter + self.n * np.outer(d, d)


def _partial(dimension: int, shift: np.ndarray) -> object:
    """A task's sums over its rows (label, vec), for each label: rows, sums and upper products about ``shift``, as (label, place, value)."""
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dimension) - shift
            labels = b.column(0).dictionary_encode()
            codes = labels.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                own = x[codes == code]
                found = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
                label = None if code < 0 else labels.dictionary[int(code)].as_py()
                sums[label] = sums[label] + found if label in sums else found
        for label, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.string()), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["label", "place", "value"])

    return run


def _unpack(values: np.ndarray, dimension: int, shift: np.ndarray) -> Moments:
    n, first = int(values[0]), values[1 : 1 + dimension]
    second = np.zeros((dimension, dimension))
    second[np.triu_indices(dimension)] = values[1 + dimension :]
    second = second + np.triu(second, 1).T
    d = first / max(n, 1)
    return Moments(n, shift + d, second - n * np.outer(d, d))


def _moments_of(points: DataFrame, dimension: int, label: Column, vec: str) -> dict[str | None, Moments]:
    """Moments of each label's rows that have all ``dimension`` entries; rows with a null or missing entry or a NaN are left out, further entries aren't read.  Sums are taken about a first row, so that large offsets don't cancel digits."""
    whole = (F.size(vec) >= dimension) & ~F.exists(F.slice(vec, 1, dimension), lambda x: x.isNull() | F.isnan(x))
    entries = F.slice(F.col(vec).cast("array<double>"), 1, dimension)
    read = points.where(F.col(vec).isNotNull() & whole).select(label.cast("string").alias("label"), entries.alias("vec"))
    one = read.select("vec").first()
    if one is None:
        return {}
    ship(points.sparkSession)
    shift = np.array(one[0][:dimension], float)
    parts = read.mapInArrow(_partial(dimension, shift), "label string, place int, value double")
    found: dict[str | None, np.ndarray] = {}
    for r in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["label"], np.zeros(1 + dimension + dimension * (dimension + 1) // 2))[r["place"]] = r["value"]
    return {x: _unpack(v, dimension, shift) for x, v in found.items()}


def moments(points: DataFrame, dimension: int, vec: str = "vec") -> Moments:
    """Moments of all rows that have a vector."""
    found = _moments_of(points, dimension, F.lit(""), vec)
    return found.get("", Moments(0, np.zeros(dimension), np.zeros((dimension, dimension))))


def moments_by(points: DataFrame, dimension: int, label: str = "label", vec: str = "vec") -> dict[str, Moments]:
    """Moments of each class; classes are few by contract, like the columns of a confusion table."""
    return {str(x): m for x, m in _moments_of(points, dimension, F.col(label), vec).items()}


def scatter_within(classes: dict[str, Moments]) -> np.ndarray:
    return sum(m.scatter for m in classes.values())


def scatter_between(classes: dict[str, Moments]) -> np.ndarray:
    n = sum(m.n for m in classes.values())
    mean = sum(m.n * m.mean for m in classes.values()) / max(n, 1)
    return sum(m.n * np.outer(m.mean - mean, m.mean - mean) for m in classes.values())


def table_of(matrix: np.ndarray, points: DataFrame, places: int = 6) -> DataFrame:
    """A small matrix as (a, b, value) rows."""
    rows = [(i, j, round(float(matrix[i, j]), places) + 0.0) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return points.sparkSession.createDataFrame(rows, "a int, b int, value double")
