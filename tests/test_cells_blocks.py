"""The metric index against brute force, block shapes, distortion by block sums, ragged vectors, and frames between tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks, cells, diagnostics
from planewise.operators.moments import moments, moments_by
from planewise.operators.neighbors import knn
from planewise.operators.pairs import pairs, space
from planewise.plans import transitions
from planewise.sources import fixtures

METRICS = [m for m in REGISTRY.ids() if REGISTRY.get(m).is_metric]


def _points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "object_id string, vec array<double>")


def _beliefs(n, k, seed, clusters=6):
    """Clustered beliefs with zeros, many copies of one vector and a few of others."""
    r = np.random.default_rng(seed)
    centres = r.dirichlet(np.full(k, 0.4), clusters)
    out = r.dirichlet(np.ones(k), n) * 0.1 + centres[r.integers(0, clusters, n)] * 0.9
    out[n // 10 : n // 10 + n // 3] = out[0]
    out[n // 2 : n // 2 + 6] = out[1]
    out[-5:] = np.eye(k)[r.integers(0, k, 5)]
    return [(f"p{i:04d}", v / v.sum()) for i, v in enumerate(out)]


def _sorted(df):
    return sorted(map(tuple, df.select("src_id", "rank", "neighbor_id", "distance").collect()))


@pytest.mark.parametrize("metric", METRICS)
def test_exact_search_is_brute_force(spark, metric):
    m, points = REGISTRY.get(metric), _points(spark, [*_beliefs(240, 4, 3), ("none", None)])
    found = cells.neighbours(blocks.placed(points, "vec", 4, m, []), 4, m, 4)
    assert _sorted(found) == _sorted(knn(pairs(space(points, "vec", 4, m)), 4))


def test_parts_of_cells_and_of_visitors(spark, monkeypatch):
    m, points = REGISTRY.get("hellinger"), _points(spark, _beliefs(300, 3, 8))
    wanted = _sorted(knn(pairs(space(points, "vec", 3, m)), 3))
    monkeypatch.setattr(cells, "PART_ROWS", 7)
    monkeypatch.setattr(cells, "VISIT_ROWS", 11)
    monkeypatch.setattr(cells, "HELD_ROWS", 5)
    placed = blocks.placed(points, "vec", 3, m, [])
    assert _sorted(cells.neighbours(placed, 3, m, 3, pivots=9)) == wanted
    few = cells.neighbours(placed, 3, m, 3, asked=F.col("object_id").endswith("7"))
    assert _sorted(few) == [r for r in wanted if r[0].endswith("7")]


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_points(spark, n):
    m, points = REGISTRY.get("euclidean"), _points(spark, [(f"p{i}", [0.5, 0.5]) for i in range(n)])
    for probes in (None, 1):
        found = cells.neighbours(blocks.placed(points, "vec", 2, m, []), 2, m, 3, probes=probes)
        assert _sorted(found) == sorted((f"p{i}", r + 1, f"p{j}", 0.0) for i in range(n) for r, j in enumerate([j for j in range(n) if j != i][:3]))
    with pytest.raises(ValueError):
        cells.neighbours(blocks.placed(points, "vec", 2, m, []), 2, m, 0)


def test_clustered_points_meet_few_cells(spark, monkeypatch):
    """Under a tenth of all visits that there could be."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 5)) * 50
    points = _points(spark, [(f"p{i:04d}", centres[i % 60] + r.normal(size=5)) for i in range(1800)])
    m, seen = REGISTRY.get("euclidean"), []
    real = cells.cut
    monkeypatch.setattr(cells, "cut", lambda df: seen.append(out := real(df)) or out)
    found = cells.neighbours(blocks.placed(points, "vec", 5, m, []), 5, m, 5, pivots=120)
    visits = next(df for df in seen if df.columns[0] == "gid" and df.columns[-1] == "cell")
    assert visits.count() < 0.1 * 1800 * 120
    assert _sorted(found) == _sorted(knn(pairs(space(points, "vec", 5, m)), 5))


def test_recall_of_the_approximate_search(spark):
    m, points = REGISTRY.get("jensen_shannon"), _points(spark, _beliefs(600, 5, 4))
    placed = blocks.placed(points, "vec", 5, m, [])
    exact = cells.neighbours(placed, 5, m, 5)
    some = {p: cells.recall(cells.neighbours(placed, 5, m, 5, probes=p), exact).first() for p in (1, 6, 10_000)}
    assert some[1]["recall"] < some[6]["recall"] and some[6]["recall"] >= 0.9 and some[10_000]["recall"] == 1.0
    assert some[1]["n_neighbors"] == 3000


def test_block_shapes():
    """Points are sent about as often as the root of the number of tasks."""
    for n in (100_000, 1_000_000, 10_000_000):
        left, right = blocks.shape(n, 16)
        assert max(left, right) <= max(32, 1.01 * np.sqrt(left * right))
    assert blocks.shape(1, 16) == (1, 1) and blocks.shape(0, 16) == (1, 1) and blocks.shape(2_000, 8) == (16, 1)


@pytest.mark.parametrize("rows", [20_000, 4])
def test_distortion_and_stress_by_sums(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "LEFT_ROWS", rows)
    monkeypatch.setattr(blocks, "RIGHT_ROWS", rows)
    m, v = REGISTRY.get("hellinger"), F.col("vec")
    points = fixtures.calibration(spark).select("object_id", "vec").union(_points(spark, [("twin", [0.7, 0.2, 0.1]), ("none", None)]))
    placed = blocks.placed(points, "vec", 3, m, [(v[0], v[1])])
    both = pairs(space(points, "vec", 3, m, (v[0], v[1])))
    plain = {r["object_id"]: r["distortion"] for r in diagnostics.point_distortion(both).collect()}
    assert {r["object_id"]: r["distortion"] for r in diagnostics.distortion_of_blocks(placed, 3, m).collect()} == pytest.approx(plain)
    near = blocks.neighbours(placed, 3, m, 1, 1, ranks=(), sums=True)
    assert diagnostics.stress_of_blocks(near).first() == diagnostics.stress(both).first()
    same = blocks.placed(_points(spark, [("a", [1, 0, 0]), ("b", [1, 0, 0])]), "vec", 3, m, [(v[0], v[1])])
    assert {r["distortion"] for r in diagnostics.distortion_of_blocks(same, 3, m).collect()} == {1.0}


def test_moments_leave_out_what_is_not_whole(spark):
    rows = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("c", [2.0, 2.0, 9.0]), ("d", [1.0]), ("e", [None, 1.0]), ("f", None), ("g", [float("nan"), 1.0]), ("h", [])]
    points = spark.createDataFrame([(i, v, "x") for i, v in rows], "object_id string, vec array<double>, label string").coalesce(1)
    whole = np.array([[1, 2], [3, 5], [2, 2.0]])
    got = moments(points, 2)
    assert got.n == 3 and got.mean == pytest.approx(whole.mean(axis=0)) and got.covariance == pytest.approx(np.cov(whole.T))
    assert moments_by(points, 2)["x"].n == 3 and moments(points.where("object_id = 'd'"), 2).n == 0


def test_geodesic_frames(spark):
    a = _points(spark, [("x", [1, 0, 0]), ("y", [0.2, 0.3, 0.5]), ("z", [0.5, 0.5, 0]), ("only", [1, 0, 0]), ("null", None)])
    b = _points(spark, [("x", [0, 1, 0]), ("y", [0.2, 0.3, 0.5]), ("z", [0.1, 0.1, 0.8]), ("null", [1, 0, 0])])
    rows = {(r["object_id"], r["frame"]): r["vec"] for r in transitions.domain_geodesic(a, b, 5).collect()}
    assert {i for i, _ in rows} == {"x", "y", "z"} and all(sum(v) == pytest.approx(1) and min(v) >= 0 for v in rows.values())
    assert rows["x", 2] == pytest.approx([0.5, 0.5, 0]) and rows["z", 0] == pytest.approx([0.5, 0.5, 0]) and rows["z", 4] == pytest.approx([0.1, 0.1, 0.8])
    assert all(rows["y", f] == pytest.approx([0.2, 0.3, 0.5]) for f in range(5))
    steps = [2 * np.arccos(min(1.0, np.sqrt(rows["z", f]) @ np.sqrt(rows["z", f + 1]))) for f in range(4)]
    assert steps == pytest.approx([steps[0]] * 4)  # at constant speed under the Fisher-Rao metric
    with pytest.raises(ValueError):
        transitions.domain_geodesic(a, b, 1)


@pytest.mark.parametrize("flip", [1, -1])
def test_procrustes_undoes_a_similarity(spark, flip):
    r = np.random.default_rng(2)
    xy = r.normal(size=(40, 2)) * [3, 1] + [5, -2]
    turn = np.array([[np.cos(2), -np.sin(2)], [np.sin(2), np.cos(2)]]) @ np.diag([1, flip])
    other = 0.3 * xy @ turn.T + [7, 7]
    table = lambda p: spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(p)], "object_id string, x double, y double")
    rows = transitions.procrustes_morph(table(xy), table(other), 3).collect()
    assert len(rows) == 120 and not any(r["valid"] for r in rows)
    assert all((r["x"], r["y"]) == pytest.approx(tuple(xy[int(r["object_id"][1:])])) for r in rows)
    assert transitions.procrustes_morph(table(xy[:0]), table(other), 2).collect() == []
    assert len(transitions.procrustes_morph(table(xy[:1]), table(other[:1]), 2).collect()) == 2
