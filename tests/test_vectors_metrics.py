"""Transforms and metrics: golden values on the calibration simplex, axioms on random rows, registry rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planewise.errors import CompatibilityError
from planewise.functions import vectors
from planewise.functions.metrics import REGISTRY, Metric, MetricRegistry, euclidean
from planewise.operators import neighbors
from planewise.operators.pairs import pairs, space
from planewise.sources import fixtures

# Golden distances of the calibration simplex.
GOLDEN = {
    ("corner_0", "corner_1"): (1.414214, 1.0, 3.141593, 19.538080, 1.0),
    ("corner_0", "midpoint_01"): (0.707107, 0.541196, 1.570796, 11.008256, 0.557923),
    ("corner_0", "center"): (0.816497, 0.650115, 1.910633, 11.280316, 0.677605),
    ("midpoint_01", "center"): (0.408248, 0.428373, 1.230959, 10.714364, 0.436892),
    ("interior_00", "interior_03"): (0.141421, 0.083528, 0.236391, 0.408793, 0.100197),
}
METRICS = ("euclidean", "hellinger", "fisher_rao", "aitchison", "jensen_shannon")


def _distances(points, metric, dimension=3):
    got = pairs(space(points, "vec", dimension, REGISTRY.get(metric))).collect()
    return {(r["i"], r["j"]): r["h"] for r in got}


@pytest.mark.parametrize("metric", METRICS)
def test_golden_distances(spark, metric):
    d = _distances(fixtures.calibration(spark), metric)
    for pair, values in GOLDEN.items():
        assert d[pair] == pytest.approx(values[METRICS.index(metric)], abs=2e-6)


@pytest.mark.parametrize(("metric", "target", "want"), [
    ("euclidean", "corner_0", ["interior_00", "interior_03", "midpoint_01"]),
    ("aitchison", "corner_0", ["interior_00", "interior_03", "interior_06"]),
    ("euclidean", "midpoint_01", ["interior_03", "interior_06", "interior_00"]),
    ("fisher_rao", "midpoint_01", ["interior_03", "interior_00", "interior_06"]),
    ("jensen_shannon", "center", ["interior_06", "interior_07", "interior_03"]),
])
def test_golden_neighbours(spark, metric, target, want):
    s = space(fixtures.calibration(spark), "vec", 3, REGISTRY.get(metric))
    assert [r["neighbor_id"] for r in neighbors.knn_of(pairs(s, target), 3).collect()] == want
    near = neighbors.knn(pairs(s), 3).where(F.col("src_id") == target).orderBy("rank").collect()
    assert [r["neighbor_id"] for r in near] == want


@pytest.mark.parametrize("metric", METRICS)
def test_axioms(spark, metric):
    r = random.Random(metric)
    rows = []
    for i in range(14):
        v = [r.random() * (r.random() > 0.2) + 1e-3 for _ in range(4)]
        rows.append((f"o{i:02d}", [x / sum(v) for x in v]))
    rows.append(("twin", rows[0][1]))
    d = _distances(spark.createDataFrame(rows, "object_id string, vec array<double>"), metric, 4)
    ids = [i for i, _ in rows]
    assert d["o00", "twin"] == pytest.approx(0, abs=1e-6)
    for a in ids:
        for b in ids:
            if a != b:
                assert d[a, b] >= 0 and d[a, b] == pytest.approx(d[b, a], abs=1e-9)
                assert all(d[a, b] <= d[a, c] + d[c, b] + 1e-6 for c in ids if c not in (a, b))


def test_block_join_equals_broadcast(spark, monkeypatch):
    s = space(fixtures.calibration(spark), "vec", 3, REGISTRY.get("hellinger"))
    want = sorted(map(tuple, pairs(s).collect()))
    monkeypatch.setattr("planewise.operators.pairs.BROADCAST_ROWS", 3)
    monkeypatch.setattr("planewise.operators.pairs.BLOCK_ROWS", 4)
    blocked = pairs(s)
    assert sorted(map(tuple, blocked.collect())) == want
    assert "CartesianProduct" not in blocked._jdf.queryExecution().toString() and "NestedLoop" not in blocked._jdf.queryExecution().toString()


def test_transforms(spark):
    df = spark.createDataFrame([("corner", [1.0, 0.0, 0.0]), ("mid", [0.5, 0.5, 0.0]), ("in", [0.7, 0.2, 0.1])], "id string, v array<double>")
    v = F.col("v")
    got = {r["id"]: r for r in df.select("id", vectors.clr(v).alias("clr"), vectors.entropy(v).alias("h"), vectors.entropy(v, "nats").alias("n"), vectors.sqrt_probability(v).alias("s"), vectors.logit(v).alias("l"), vectors.softmax(v).alias("e"), vectors.argmax(v).alias("a")).collect()}
    assert got["corner"]["clr"] == pytest.approx([9.210339, -4.605170, -4.605170], abs=1e-5)
    assert all(abs(sum(r["clr"])) < 1e-9 and abs(sum(r["e"]) - 1) < 1e-12 for r in got.values())
    assert [round(got[k]["h"], 6) for k in ("corner", "mid", "in")] == [0.0, 1.0, 1.15678]
    assert math.copysign(1, got["corner"]["h"]) == 1 and got["mid"]["n"] == pytest.approx(math.log(2))
    assert got["in"]["s"] == pytest.approx([math.sqrt(x) for x in (0.7, 0.2, 0.1)]) and got["corner"]["l"][0] == pytest.approx(math.log((1 - 1e-6) / 1e-6))
    assert got["mid"]["a"] == 0
    with pytest.raises(Exception, match="negative probability"):
        df.select(vectors.sqrt_probability(F.array(F.lit(-0.1)))).collect()
    with pytest.raises(ValueError):
        vectors.entropy(v, "dits")


def test_labels(spark):
    df = spark.createDataFrame([("", None, "t", "p", 2, "t"), (None, None, None, "", 2, "ambiguous"), ("c", "x", "t", "p", 0, None)], "a string, b string, c string, d string, k int, truth string")
    got = df.select(vectors.label(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("k")).alias("l"), vectors.correct(F.col("truth"), F.col("truth")).alias("ok")).collect()
    assert [r["l"] for r in got] == ["t", "2", "c"] and [r["ok"] for r in got] == [True, False, False]


def test_registry():
    r = MetricRegistry()
    assert r.compatible("euclidean", "logits").id == "euclidean"
    with pytest.raises(KeyError):
        r.get("cosine")
    with pytest.raises(CompatibilityError):
        r.compatible("aitchison", "clr_probability")
    r.register(Metric("city", ("probability",), lambda a, b: sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))))
    assert "city" in r.ids() and REGISTRY.get("euclidean").combine is euclidean


def test_plans(spark, sf_dir):
    """The target filter stands below the join, the top-k limit below the shuffle."""
    from planewise import catalogue

    for name in ("knn_euclidean", "diagnostics_summary", "point_stability", "trustworthiness", "topology_edges"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan, name  # no row for each pair
    one = catalogue.queries()["knn_target_pushdown"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert one.index("Join") < one.index("= vec_000007") and "TakeOrdered" in catalogue.queries()["knn_target_pushdown"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
