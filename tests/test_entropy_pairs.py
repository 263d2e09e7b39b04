"""Jensen-Shannon pairs take one logarithm for each entry of a pair; what a row alone gives is taken once a row."""

from __future__ import annotations

import math
import re

import numpy as np

from planewise.functions.metrics import REGISTRY
from planewise.operators import pairs


def _plain(a, b):
    half = lambda x, y: 0.5 * x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return min(1.0, math.sqrt(max(0.0, sum(half(x, y) + half(y, x) for x, y in zip(a, b, strict=True)))))


def test_pairs_by_entropies(spark):
    counts = np.random.default_rng(3).integers(0, 4, (40, 5))
    counts[:, 0] += counts.sum(axis=1) == 0
    rows = [(f"p{i:02d}", (c / c.sum()).tolist()) for i, c in enumerate(counts)] + [("q0", [1.0, 0.0, 0.0, 0.0, 0.0]), ("q1", [0.0, 1.0, 0.0, 0.0, 0.0]), ("q2", [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "object_id string, vec array<double>")
    got = pairs.pairs(pairs.space(df, "vec", 5, REGISTRY.get("jensen_shannon")), unordered=True)
    of, seen = dict(rows), got.collect()
    assert len(seen) == len(rows) * (len(rows) - 1) // 2
    for r in seen:
        assert abs(r["h"] - _plain(of[r["i"]], of[r["j"]])) < 1e-7
        assert r["h"] == 0.0 or of[r["i"]] != of[r["j"]]
    assert {r["h"] for r in seen if r["i"] == "q0" and r["j"] in ("q1", "q2")} == {0.0, 1.0}
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert len(re.findall(r"\b(?:ln|log2?)\(", above.lower())) == 5
