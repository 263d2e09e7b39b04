"""All pairs block by block: once each, spread over tasks, rounded without decimals; neighbours of shares that repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise import catalogue
from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks
from planewise.operators.neighbors import result, result_of_pair
from planewise.operators.pairs import pairs, space


@pytest.mark.parametrize("metric", REGISTRY.ids())
def test_blocks_meet_once_and_in_many_tasks(spark, monkeypatch, metric):
    r = np.random.default_rng(4)
    rows = [(f"o{i:02d}", [float(x) for x in v]) for i, v in enumerate(r.dirichlet(np.ones(3), 40))] + [("o07", [0.2, 0.3, 0.5]), (None, [0.2, 0.3, 0.5])]
    s = space(spark.createDataFrame(rows, "object_id string, vec array<double>"), "vec", 3, REGISTRY.get(metric))
    want = sorted(map(tuple, pairs(s, unordered=True).collect()))
    monkeypatch.setattr("planewise.operators.pairs.BROADCAST_ROWS", 3)
    monkeypatch.setattr("planewise.operators.pairs.BLOCK_ROWS", 10)
    blocked = pairs(s, unordered=True)
    assert sorted(map(tuple, blocked.collect())) == want and len(want) == 41 * 40 // 2 - 1
    assert blocked.rdd.getNumPartitions() >= 2 * 15  # five blocks, each met by itself and those after it


def test_rounding_of_pairs(spark):
    r = np.random.default_rng(3)
    some = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 0.1234565, 1.0000005, 2.6750005, 1e-300, 1e7 + 0.1234565, 1e300, float("inf"), float("nan"), None]
    values = some + (r.random(3000) * 4).tolist() + ((r.integers(0, 10**7, 3000) + 0.5) / 1e6).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double").select(result(F.col("x")).alias("a"), result_of_pair(F.col("x")).alias("b"))
    assert [str(a) for a, _ in df.collect()] == [str(b) for _, b in df.collect()]


@pytest.mark.parametrize("name", ["knn_hellinger", "knn_euclidean", "knn_aitchison", "knn_jensen_shannon", "knn_aitchison_whole", "knn_jensen_shannon_whole"])
def test_shares_that_repeat_are_measured_once(spark, tmp_path, monkeypatch, name):
    """No task meets all copies with all copies; nearest are the copies of lowest id."""
    for table, key, kind, kinds in (("orders", "o_custkey", "o_orderpriority", ("1-URGENT", "5-LOW")), ("events", "user_id", "event_type", ("click", "view"))):
        spark.createDataFrame([(i, k) for i in range(90) for k in kinds[: 1 + i % 2]], f"{key} long, {kind} string").write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(blocks, "neighbours", lambda *a, **b: pytest.fail("blocks of all points"))
    near = {}
    for r in catalogue.queries()[name](spark, str(tmp_path)).collect():
        near.setdefault(int(r["src_id"][5:]), []).append((r["rank"], int(r["neighbor_id"][5:]), r["distance"]))
    assert {i: sorted(v) for i, v in near.items()} == {i: [(n + 1, j, 0.0) for n, j in enumerate([j for j in range(i % 2, 90, 2) if j != i][:5])] for i in range(90)}
