"""Diagnostics on planted worlds, bases, catalogues, tours and candidate sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.errors import CompatibilityError
from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks, diagnostics, neighbors, projection
from planewise.operators.moments import Moments, moments, moments_by, scatter_between, scatter_within
from planewise.operators.pairs import pairs, space
from planewise.plans import bases, rashomon, tours
from planewise.plans.catalog import catalog
from planewise.sources import fixtures, generators


def _pairs(points, basis, k, target=None):
    v = F.col("vec")
    return pairs(space(points, "vec", k, REGISTRY.get("euclidean"), (projection.along(v, basis[:, 0]), projection.along(v, basis[:, 1]))), target)


def test_deception(spark):
    view = np.eye(3)[:, :2]
    both = _pairs(fixtures.deception(spark), view, 3)
    whole = diagnostics.summary(both, 6, 2).first()
    assert (whole["trustworthiness"], whole["continuity"], whole["stress"]) == pytest.approx((0.6, 0.866667, 0.570210), abs=2e-6)
    near = {r["neighbor_id"]: r["class"] for r in neighbors.classes(neighbors.both_ranks(both), 2).where("src_id = 't'").collect()}
    assert near == {"a": "preserved", "b": "torn", "f": "false"}
    row = neighbors.precision_recall(neighbors.classes(neighbors.both_ranks(both), 2)).where("src_id = 't'").first()
    assert (row["precision"], row["recall"], row["jaccard"]) == (0.5, 0.5, 0.333333)


def test_bridge_view_of_the_simplex(spark):
    both = _pairs(fixtures.calibration(spark), bases.bridge_plane(3), 3)
    whole = diagnostics.summary(both, 15, 3).first()
    assert (whole["preserved"], whole["torn"], whole["false_neighbors"]) == (21, 24, 24)
    assert (whole["trustworthiness"], whole["continuity"], whole["stress"]) == pytest.approx((0.717778, 0.862222, 0.445952), abs=2e-6)
    ranks = neighbors.both_ranks(both)
    assert diagnostics.trustworthiness(ranks, 15, 3).first()[0] == whole["trustworthiness"] and diagnostics.continuity(ranks, 15, 3).first()[0] == whole["continuity"]
    edges = neighbors.topology(neighbors.classes(ranks, 3)).collect()
    assert len({(*sorted((e["source"], e["target"])), e["type"]) for e in edges}) == len(edges)


def test_pca_of_the_simplex(spark):
    points = fixtures.calibration(spark)
    basis, values = bases.pca(moments(points, 3))
    assert values == pytest.approx([0.127857, 0.125825, 0], abs=1e-6)
    whole = diagnostics.summary(_pairs(points, basis, 3), 15, 3).first()
    assert (whole["trustworthiness"], whole["continuity"]) == (1.0, 1.0) and whole["stress"] < 1e-5


def test_small_and_degenerate(spark):
    twins = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 0.0])], "object_id string, vec array<double>")
    both = _pairs(twins, np.eye(2), 2)
    assert [r["neighbor_id"] for r in neighbors.knn(both, 1).orderBy("src_id").collect()] == ["b", "a", "a"]
    assert diagnostics.summary(both, 3, 2).first()["trustworthiness"] == 1.0
    flat = both.select("i", "j", F.lit(0.0).alias("h"), "l")
    assert diagnostics.stress(flat).first()[0] == 0.0 and diagnostics.stress(flat.select("i", "j", F.lit(1.0).alias("h"), F.lit(0.0).alias("l"))).first()[0] == 1.0
    assert {r["distortion"] for r in diagnostics.point_distortion(flat).collect()} == {1.0}
    with pytest.raises(ValueError):
        neighbors.knn(both, 0)


def test_grid_counts_boundary_points_twice(spark):
    points = spark.createDataFrame([(0.5, 0.5, 2.0), (0.1, 0.9, 1.0)], "x double, y double, distortion double")
    cells = {(r["row"], r["col"]): r["mean_distortion"] for r in diagnostics.grid(points, {"xMin": 0.0, "xMax": 1.0, "yMin": 0.0, "yMax": 1.0}, 8).collect()}
    assert cells == {(3, 3): 2.0, (3, 4): 2.0, (4, 3): 2.0, (4, 4): 2.0, (0, 0): 1.0}


def test_moments_match_numpy(spark):
    r = np.random.default_rng(0)
    data, labels = r.normal(1000, 1, (60, 4)), r.integers(0, 3, 60)
    df = spark.createDataFrame([(f"{i}", str(c), row.tolist()) for i, (row, c) in enumerate(zip(data, labels, strict=True))], "object_id string, label string, vec array<double>")
    m = moments(df, 4)
    assert np.allclose(m.covariance, np.cov(data.T), atol=1e-9) and np.allclose(m.about(np.zeros(4)), data.T @ data)
    c = moments_by(df, 4)
    assert np.allclose(scatter_within(c) + scatter_between(c), m.scatter)


def test_bases():
    planes = fixtures.orthogonal_planes()
    assert bases.grassmann_distance(planes["F1"], planes["F2"]) == pytest.approx(0, abs=1e-7)
    assert np.degrees(bases.principal_angles(planes["F1"], planes["F3"])) == pytest.approx([90, 90])
    assert np.degrees(bases.principal_angles(planes["F1"], planes["F4"])) == pytest.approx([0, 90], abs=1e-6)
    assert bases.grassmann_distance(planes["F1"], planes["F3"]) == pytest.approx(np.sqrt(2) * np.pi / 2)
    assert (bases.canonical(np.array([[-2.0, 1], [1, 3]])) == [[2, 1], [-1, 3]]).all()
    with pytest.raises(ValueError):
        bases.validate_orthonormal(np.ones((3, 2)))
    with pytest.raises(ValueError):
        bases.validate_orthonormal(np.eye(2, 3))
    a, b = bases.haar(6, seed=1), bases.haar(6, seed=2)
    whole = bases.grassmann_distance(a, b)
    for t in (0.25, 0.5, 0.9):
        p = bases.validate_orthonormal(bases.geodesic(a, b, t), 1e-9)
        assert bases.grassmann_distance(a, p) == pytest.approx(t * whole, abs=1e-6)
        assert bases.grassmann_distance(p, bases.geodesic(a, b, t, continuous=True)) == pytest.approx(0, abs=1e-6)
    assert (bases.geodesic(a, b, 0) == a).all() and (bases.geodesic(a, b, 1) == b).all()
    view = bases.FittedView("v", "probability", np.eye(3)[:, :2], ["a", "b", "c"], "h")
    view.check("probability", ["a", "b", "c"], "h")
    for wrong in (("clr", ["a", "b", "c"], "h"), ("probability", ["a", "b", "d"], "h"), ("probability", ["a", "b", "c"], "g")):
        with pytest.raises(CompatibilityError):
            view.check(*wrong)


def test_planes_of_special_sets():
    m = Moments(5, np.zeros(3), np.diag([1.0, 5.0, 3.0]))
    assert np.abs(bases.axes(m.scatter)[[1, 2], [0, 1]]) == pytest.approx([1, 1])
    assert bases.grassmann_distance(bases.integrity_plane(Moments(0, np.zeros(3), np.zeros((3, 3))), m), bases.axes(m.scatter)) == pytest.approx(0, abs=1e-7)
    one = bases.integrity_plane(Moments(1, np.array([0, 0, 2.0]), np.zeros((3, 3))), m)
    assert abs(one[2, 0]) == pytest.approx(1)
    classes = {"a": Moments(50, np.array([3.0, 0, 0]), np.eye(3) * 9), "b": Moments(50, np.array([-3.0, 0, 0]), np.eye(3) * 9), "c": Moments(50, np.array([0, 4.0, 0]), np.eye(3) * 9)}
    assert bases.grassmann_distance(bases.discriminant_plane(classes), np.eye(3)[:, :2]) == pytest.approx(0, abs=1e-6)


def test_catalog_tour_and_guided_view(spark):
    points = generators.synthetic(spark, 100, 42)
    assert points.count() == 98
    found = catalog(points, 4)
    assert list(found) == ["pca_corners", "minor_pca", "fisher_lda", "collapsed_bridge", "entropy"] and found["collapsed_bridge"].misleading
    for v in found.values():
        bases.validate_orthonormal(v.basis)
    frames = tours.grand_tour(points, 4, 24)
    low, high = frames.agg(F.min("x"), F.max("x")).first()
    assert (low, high) == pytest.approx((-1, 1)) and frames.count() == 98 * len(tours.grand_tour_bases(4, 24))
    view = tours.guided_view(points, 4, "class_separation", n_frames=5)
    assert view.frames.select("frame").distinct().count() == 5 and len(view.bases) == 5
    near = tours.guided_view(points, 4, "neighborhood_integrity", "synth_00003", 3)
    bases.validate_orthonormal(near.basis)
    with pytest.raises(ValueError):
        tours.guided_view(points, 4, "beauty")


def test_paths():
    assert tours.linear_path("a", [("v", "p"), ("w", "p")]).valid and not tours.morph_path("m", ["a", "b"]).valid and not tours.embedding_path("e", ["a"]).valid
    assert tours.Path("g", "domain_geodesic", []).valid
    for bad in (lambda: tours.linear_path("a", []), lambda: tours.linear_path("a", [("v", "p"), ("w", "q")]), lambda: tours.Path("s", "sequential_embedding", [], valid=True), lambda: tours.Path("x", "teleport", [])):
        with pytest.raises(ValueError):
            bad()


def test_rashomon_of_many_blocks(spark, monkeypatch):
    points = fixtures.calibration(spark)
    planes = [("a", np.eye(3)[:, :2]), ("b", bases.bridge_plane(3)), ("c", bases.haar(3))]
    by_one = rashomon.trust_of(points, 3, planes, 3)
    monkeypatch.setattr(blocks, "RIGHT_ROWS", 5)
    monkeypatch.setattr(blocks, "LEFT_ROWS", 6)
    assert rashomon.trust_of(points, 3, planes, 3) == pytest.approx(by_one) and by_one["b"] == pytest.approx(0.717778, abs=1e-6)


@pytest.mark.parametrize("right", [20_000, 4])
def test_blocks_equal_windows_over_pairs(spark, monkeypatch, right):
    """Ranks, sums and stability by blocks are those of all pairs; null vectors stay out and repeated ids don't meet."""
    monkeypatch.setattr(blocks, "RIGHT_ROWS", right)
    world = fixtures.calibration(spark).select("object_id", "label", "vec")
    points = world.union(spark.createDataFrame([("none", "x", None), ("twin", "x", [0.2, 0.3, 0.5]), ("twin", "x", [0.1, 0.3, 0.6])], world.schema))
    m, v, k = REGISTRY.get("hellinger"), F.col("vec"), 3
    plane = (v[0], v[1])
    all_pairs = pairs(space(points, "vec", 3, m, plane))
    n = points.where("vec is not null").count()
    placed = blocks.placed(points, "vec", 3, m, [plane])
    near = blocks.neighbours(placed, 3, m, 1, k, sums=True)
    rows = lambda df: sorted(map(tuple, df.where("src_id <> 'twin' and neighbor_id <> 'twin'").collect()))
    assert rows(neighbors.classes(neighbors.block_ranks(near), k)) == rows(neighbors.classes(neighbors.both_ranks(all_pairs), k))
    unique = points.where("object_id <> 'twin'")
    near = blocks.neighbours(blocks.placed(unique, "vec", 3, m, [plane]), 3, m, 1, k, sums=True)
    assert diagnostics.summary_of_blocks(near, n - 2, k).first() == diagnostics.summary(pairs(space(unique, "vec", 3, m, plane)), n - 2, k).first()
    with pytest.raises(ValueError):
        blocks.neighbours(placed, 3, m, 1, 0)


def test_rashomon(spark):
    points = generators.synthetic(spark, 60, 7)
    found = rashomon.rashomon_set(points, 4, threshold=0.5)
    assert 1 <= len(found) <= 6 and all(c.trustworthiness >= 0.5 for c in found)
    assert [c.trustworthiness for c in found] == sorted((c.trustworthiness for c in found), reverse=True)
    for i, a in enumerate(found):
        for b in found[:i]:
            assert np.degrees(bases.grassmann_distance(a.basis, b.basis)) >= 12 - 1e-6
    plane = [("p", found[0].basis)]
    v = F.col("vec")
    s = space(points, "vec", 4, REGISTRY.get("euclidean"), (projection.along(v, found[0].basis[:, 0]), projection.along(v, found[0].basis[:, 1])))
    assert rashomon.trust_of(points, 4, plane)["p"] == pytest.approx(diagnostics.summary(pairs(s), points.count(), 5).first()["trustworthiness"], abs=1e-6)


def test_stability_both_ways(spark):
    points = fixtures.calibration(spark)
    m, v = REGISTRY.get("euclidean"), F.col("vec")
    planes = {"l0": np.eye(3)[:, [0, 1]], "l1": np.eye(3)[:, [1, 2]]}
    source = pairs(space(points, "vec", 3, m))
    each = {n: pairs(space(points, "vec", 3, m, (projection.along(v, b[:, 0]), projection.along(v, b[:, 1])))) for n, b in planes.items()}
    views = each["l0"].select(F.lit("l0").alias("view_id"), "i", "j", "l").unionByName(each["l1"].select(F.lit("l1").alias("view_id"), "i", "j", "l"))
    long = {r[0]: round(r[1], 9) for r in diagnostics.overlaps(source, views, 3).collect()}
    wide = source.join(each["l0"].select("i", "j", F.col("l").alias("l0")), ["i", "j"]).join(each["l1"].select("i", "j", F.col("l").alias("l1")), ["i", "j"])
    assert {r[0]: round(r[1], 9) for r in diagnostics.stability_over(wide, ["l0", "l1"], 3).collect()} == long
