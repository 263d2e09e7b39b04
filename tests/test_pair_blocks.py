"""Blocks of pairs: enough meetings for all cores, and ranges of ids for unordered pairs."""

import numpy as np
from pyspark.sql import functions as F

from planewise.functions.metrics import REGISTRY
from planewise.operators.pairs import pairs, space


def _space(spark, prefix, n):
    r = np.random.default_rng(n)
    rows = [(f"{prefix}{i:03d}", [float(x) for x in v]) for i, v in enumerate(r.dirichlet(np.ones(3), n))] + [(f"{prefix}007", [0.2, 0.3, 0.5])]
    return space(spark.createDataFrame(rows, "object_id string, vec array<double>"), "vec", 3, REGISTRY.get("hellinger"))


def test_two_sets_meet_in_many_tasks(spark, monkeypatch):
    """Two blocks by five were ten meetings, in a few tasks, some of them with several."""
    a, b = _space(spark, "a", 16), _space(spark, "b", 40)
    want = sorted(map(tuple, pairs(a, other=b).collect()))
    monkeypatch.setattr("planewise.operators.pairs.BROADCAST_ROWS", 3)
    monkeypatch.setattr("planewise.operators.pairs.BLOCK_ROWS", 10)
    met = pairs(a, other=b)
    assert sorted(map(tuple, met.collect())) == want and len(want) == 17 * 41
    assert met.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_unordered_pairs_come_in_runs_of_ids(spark, monkeypatch):
    """In a task rows of one i lie together, so that they are written as runs; ids of both sides took turns before."""
    s = _space(spark, "o", 300)
    want = sorted(map(tuple, pairs(s, unordered=True).collect()))
    monkeypatch.setattr("planewise.operators.pairs.BROADCAST_ROWS", 3)
    monkeypatch.setattr("planewise.operators.pairs.BLOCK_ROWS", 60)
    blocked = pairs(s, unordered=True)
    assert sorted(map(tuple, blocked.collect())) == want and len(want) == 301 * 300 // 2 - 1
    rows = blocked.select("i", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    runs = 1 + sum(x["i"] != y["i"] for x, y in zip(rows, rows[1:]))
    assert runs < len(rows) / 8
