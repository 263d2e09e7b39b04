"""Ranks of the neighbours in many planes: one plane at a time, so that a task's memory doesn't grow with all their distances."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks
from planewise.plans import bases, rashomon

K = 5


def _points(n):
    p = np.random.default_rng(n).dirichlet(np.ones(10), n)
    p[n // 2 : n // 2 + 9] = p[0]
    return pd.DataFrame({"object_id": [f"o{i:05d}" for i in range(n)]} | {f"s{k}": p[:, k] for k in range(10)})


def _plain(points, planes):
    x = points.filter(like="s").to_numpy()
    ranks = lambda p: np.argsort(np.argsort(np.where(np.eye(len(p), dtype=bool), np.inf, np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)), 9)), axis=1, kind="stable"), axis=1) + 1
    source = ranks(x)
    return [int(np.maximum(source - K, 0)[ranks(x @ b) <= K].sum()) for b in planes]


@pytest.mark.parametrize("far", [0.0, np.inf])
def test_penalties_of_blocks(monkeypatch, far):
    points, planes = _points(300), [bases.haar(10, 2, s) for s in range(4)]
    task = blocks._Planes(REGISTRY.get("euclidean"), 10, planes, K)
    if far:  # blocks without keys measure all pairs
        monkeypatch.setattr(blocks._Meeting, "keyed", lambda *a: None)
    assert task.lost(points.sample(frac=1, random_state=1), points)["lost"].tolist() == _plain(points, planes)
    found = task.seen(points, points.sample(frac=1, random_state=2))
    asked = points.merge(found.rename(columns={"i": "object_id"}).groupby("object_id")[["v", "j", "d"]].agg(list).reset_index())
    parts = [task.counted(asked, points[c::2]) for c in range(2)]
    rank = np.concatenate(parts[0]["c"].to_numpy()) + np.concatenate(parts[1]["c"].to_numpy()) + 1
    lost = np.bincount(np.concatenate(asked["v"].to_numpy()), np.maximum(rank - K, 0))
    assert [int(x) for x in lost] == _plain(points, planes)


def test_a_task_holds_little_for_each_left_point():
    """3,000 left points more took 137 MB more when the distances by all measures of all pairs were held, of 16 planes."""
    points, peaks = _points(4000), []
    task = blocks._Planes(REGISTRY.get("euclidean"), 10, [bases.haar(10, 2, s) for s in range(16)], K)
    for n in (1000, 4000):
        tracemalloc.start()
        task.lost(points[:n], points)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < 80e6 and peaks[1] - peaks[0] < 3000 * 15_000


def test_trust_doesnt_take_all_measures_of_all_pairs(spark, monkeypatch):
    points = spark.createDataFrame([(f"o{i}", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).dirichlet(np.ones(3), 30))], "object_id string, vec array<double>")
    planes = [("a", np.eye(3)[:, :2]), ("b", bases.haar(3))]
    monkeypatch.setattr(blocks, "neighbours", lambda *a, **b: pytest.fail("a table with a column for each plane"))
    one = rashomon.trust_of(points, 3, planes)
    monkeypatch.setattr(blocks, "RIGHT_ROWS", 7)
    assert rashomon.trust_of(points, 3, planes) == one


def test_many_limits_open_few_searches(monkeypatch):
    """Keys of single precision left a part of the limits open in each chunk, and each own key opened its limit."""
    points, planes, seen = _points(1500), [bases.haar(10, 2, s) for s in range(8)], []
    monkeypatch.setattr(blocks, "_where", lambda x, f=blocks._where: seen.append(len(x)) or f(x))
    task = blocks._Planes(REGISTRY.get("euclidean"), 10, planes, K)
    right = points.sort_values("object_id")
    rows, at, d = (np.concatenate(x, axis=-1) for x in zip(*task._near(points[:200], right), strict=True))
    del seen[:]
    keyed = task.meeting.keyed(points[:200], right)
    got = keyed.before(0, rows, d[0], at)
    assert sum(seen) < len(rows) / 5
    assert got.tolist() == keyed.before(0, rows, d[0], at, np.zeros(len(rows), bool)).tolist()
