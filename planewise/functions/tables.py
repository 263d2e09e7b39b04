"""Table functions for Spark SQL: representations, planes and neighbours of a table of vectors.

``register`` makes them known to a session.  Each takes a TABLE argument with a string
``object_id`` and an array ``vec``; rows without either are left out.

- ``represent(TABLE(t), 'clr_probability')``: object_id, vec.
- ``project(TABLE(t), array(array(1, 0), array(0, 1), ...))``: object_id, x, y on the columns of a basis.
- ``dealt(TABLE(t), n)``: a row for every pair of ``n`` blocks that the point stands in, as left or as right point.
- ``neighbours(TABLE(d) PARTITION BY (a, b), k, 'hellinger')``: of the rows that ``dealt`` gives, src_id, neighbor_id
  and distance of the k nearest right points of each left one.  Each pair of blocks is one
  call, so tasks hold two blocks; the k nearest of all are those of its rows, by SQL.

Metrics are those of the registry: one that a user registers in block form, before
``register``, is known by its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from planewise.conventions import CLR_DELTA, LOGIT_EPS
from planewise.functions.metrics import REGISTRY, Metric
from planewise.operators.blocks import _Meeting
from planewise.shipping import ship


def transformed(representation: str, x: np.ndarray) -> np.ndarray:
    """Probabilities, a row each, in a representation."""
    if representation == "probability":
        return x
    if representation == "sqrt_probability":
        return np.sqrt(np.maximum(x, 0.0))
    if representation == "clr_probability":
        zero = x == 0
        logs = np.log(np.where(zero, CLR_DELTA, x * (1.0 - CLR_DELTA * zero.sum(axis=1, keepdims=True))))
        return logs - logs.mean(axis=1, keepdims=True)
    if representation == "logit":
        c = np.clip(x, LOGIT_EPS, 1.0 - LOGIT_EPS)
        return np.log(c / (1.0 - c))
    raise ValueError(f"unknown representation {representation!r}")


#: What a metric's blocks are made of.
PREPARED = {"hellinger": "sqrt_probability", "fisher_rao": "sqrt_probability", "bhattacharyya": "sqrt_probability", "aitchison": "clr_probability"}


def _whole(row: Row) -> bool:
    return row["object_id"] is not None and row["vec"] is not None and None not in row["vec"]


class Represent:
    def eval(self, row: Row, representation: str) -> Iterator[tuple]:
        if _whole(row):
            yield row["object_id"], transformed(representation, np.array([row["vec"]], float))[0].tolist()


class Project:
    def eval(self, row: Row, basis: list[list[float]]) -> Iterator[tuple]:
        if _whole(row):
            x, y = np.array(row["vec"], float) @ np.array(basis, float)
            yield row["object_id"], float(x), float(y)


class Dealt:
    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        if _whole(row):
            own = zlib.crc32(row["object_id"].encode()) % n
            vec = [float(x) for x in row["vec"]]
            for other in range(n):
                yield own, other, True, row["object_id"], vec
                yield other, own, False, row["object_id"], vec


def neighbours_of(metrics: dict[str, Metric]) -> type:
    class Neighbours:
        def __init__(self) -> None:
            self.sides: dict[bool, tuple[list[str], list[list[float]]]] = {True: ([], []), False: ([], [])}
            self.k, self.metric = 0, ""

        def eval(self, row: Row, k: int, metric: str) -> None:
            self.k, self.metric = k, metric
            ids, vectors = self.sides[row["lefts"]]
            ids.append(row["object_id"])
            vectors.append(row["vec"])

        def terminate(self) -> Iterator[tuple]:
            (ids, left), (others, right) = self.sides[True], self.sides[False]
            if not left or not right:
                return
            if self.k < 1:
                raise ValueError("k must be 1 at least")
            a, b = (transformed(PREPARED.get(self.metric, "probability"), np.array(x, float)) for x in (left, right))
            meeting = _Meeting(metrics[self.metric], a.shape[1], 0, self.k)
            sides = (pd.DataFrame(x, columns=meeting.entries).assign(object_id=np.array(names, object)) for x, names in ((a, ids), (b, others)))
            near = meeting.nearest(*sides, (), False)
            yield from zip(near["i"], near["j"], near["d0"].tolist(), strict=True)

    return Neighbours


def register(spark: SparkSession) -> None:
    """Make ``represent``, ``project``, ``dealt`` and ``neighbours`` known to the session's SQL, with the metrics registered by now."""
    ship(spark)
    metrics = {m: REGISTRY.get(m) for m in REGISTRY.ids() if REGISTRY.get(m).block}
    known = {m: Metric(m, x.representations, None, x.block, key=x.key) for m, x in metrics.items()}  # what tasks need, without columns
    for name, made, returns in (
        ("represent", Represent, "object_id string, vec array<double>"),
        ("project", Project, "object_id string, x double, y double"),
        ("dealt", Dealt, "a int, b int, lefts boolean, object_id string, vec array<double>"),
        ("neighbours", neighbours_of(known), "src_id string, neighbor_id string, distance double"),
    ):
        spark.udtf.register(name, udtf(made, returnType=returns))
