"""Rows that repeat meet as one: every pair once, few rows are sent, and written pairs hold runs of a distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.functions.metrics import REGISTRY
from planewise.operators import pairs as operator
from planewise.operators.pairs import pairs, space


def _space(spark, prefix, n, kinds, metric="hellinger"):
    some = np.random.default_rng(3).dirichlet(np.ones(3), kinds).tolist()
    rows = [(f"{prefix}{i:03d}", some[i % kinds if i % 4 else 0]) for i in range(n)] + [(f"{prefix}007", [0.0, 1.0, 0.0]), (f"{prefix}900", [0.0, 1.0, -0.0]), (None, some[0])]
    return space(spark.createDataFrame(rows, "object_id string, vec array<double>"), "vec", 3, REGISTRY.get(metric))


@pytest.fixture
def blocked(monkeypatch):
    def small():
        for name, n in (("BROADCAST_ROWS", 3), ("COPIES", 8), ("BLOCK_IDS", 20)):
            monkeypatch.setattr(operator, name, n)

    return small


@pytest.mark.parametrize("metric", ["hellinger", "jensen_shannon", "fisher_rao"])
def test_unordered_and_ordered_pairs(spark, blocked, metric):
    s = _space(spark, "o", 120, 9, metric)
    want = [sorted(map(tuple, pairs(s, unordered=u).collect())) for u in (True, False)]
    blocked()
    seen = [pairs(s, unordered=u) for u in (True, False)]
    assert [sorted(map(tuple, x.collect())) for x in seen] == want and len(want[0]) == 122 * 121 // 2 - 1
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(i") < plan.index("Coalesce") < plan.index("SortMergeJoin")  # the join doesn't hold what is dealt out of its rows


def test_two_sets(spark, blocked):
    a, b = _space(spark, "a", 60, 7), _space(spark, "b", 90, 9)
    key = lambda r: (r[0] or "", r[1] or "", r[2])
    want = sorted(map(tuple, pairs(a, other=b).collect()), key=key)
    blocked()
    assert sorted(map(tuple, pairs(a, other=b).collect()), key=key) == want and len(want) == 63 * 93


def test_written_distances_come_in_runs(spark, blocked, tmp_path):
    """Of 40 copies each; distances of neighbouring rows differed before, so each took its eight bytes."""
    s = _space(spark, "o", 320, 8)
    blocked()
    rows = pairs(s, unordered=True).select("h", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    runs = 1 + sum(x["h"] != y["h"] for x, y in zip(rows, rows[1:]))
    assert len(rows) == 322 * 321 // 2 - 1 and runs < len(rows) / 8


def test_copies_of_one_row_are_dealt_out(spark, blocked):
    """A vector that all share stands in many rows of few ids."""
    rows = [(f"o{i:03d}", [0.5, 0.5]) for i in range(200)]
    blocked()
    held, n, ids = operator._as_one(space(spark.createDataFrame(rows, "object_id string, vec array<double>"), "vec", 2, REGISTRY.get("euclidean")).frame)
    assert (n, ids) == (25, 200) and held.select(F.max(F.size("ids"))).first()[0] < 25
