"""The renderer's contract, uploads, dataset entries, populations and benchmark tables."""

import numpy as np
import pytest

from planewise import cli
from planewise.errors import ImportValidationError
from planewise.plane_view import PlaneView
from planewise.sources import datasets, fixtures, generators
from planewise.workbench import Workbench


def test_plane_view_checks_what_is_set(spark):
    v, points = PlaneView(), fixtures.calibration(spark)
    for early in (lambda: v.set_selection(["center"]), lambda: v.set_basis(np.eye(3)[:, :2]), v.frame):
        with pytest.raises(ValueError):
            early()
    v.load(points)
    assert v.current_basis() is None
    v.set_basis(np.eye(3)[:, :2])
    v.set_selection({"center", "corner_0"})
    rows = v.frame().collect()
    assert len(rows) == 15 and {r["object_id"] for r in rows if r["selected"]} == {"center", "corner_0"}
    assert [(r["x"], r["y"]) for r in rows if r["object_id"] == "corner_1"] == [(0.0, 1.0)]
    for wrong in (lambda: v.set_selection(["nobody"]), lambda: v.set_basis(np.eye(4)[:, :2]), lambda: v.set_basis(np.ones((3, 2)))):
        with pytest.raises(ValueError):
            wrong()
    v.set_basis(None)
    assert v.current_basis() is None


@pytest.mark.parametrize(
    ("rows", "schema", "error"),
    [
        ([(1, [1.0, 2.0])], "object_id long, vec array<double>", TypeError),
        ([("a", ["x", "y"])], "object_id string, vec array<string>", TypeError),
        ([("a", [1.0, 2.0]), ("a", [1.0, 2.0])], "object_id string, vec array<double>", ValueError),
        ([(" ", [1.0, 2.0])], "object_id string, vec array<double>", ValueError),
        ([(None, [1.0, 2.0])], "object_id string, vec array<double>", ValueError),
        ([("a", [1.0])], "object_id string, vec array<double>", ValueError),
        ([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])], "object_id string, vec array<double>", ValueError),
        ([("a", [1.0, float("nan")])], "object_id string, vec array<double>", ValueError),
        ([("a", None)], "object_id string, vec array<double>", ValueError),
        ([], "object_id string, vec array<double>", ValueError),
    ],
)
def test_plane_view_refuses(spark, rows, schema, error):
    with pytest.raises(error):
        PlaneView().load(spark.createDataFrame(rows, schema))


def test_populations_of_the_world(spark):
    world = generators.synthetic(spark, 400, 1)
    held = {r["generator_component"]: r["count"] for r in world.groupBy("generator_component").count().collect()}
    assert held == {**{f"confident_corner_{c}": 60 for c in range(4)}, "ambiguity_band_01": 40, "ambiguity_band_23": 40, "high_entropy_center": 32, "narrow_bridge_02": 20, "evidence_trajectory": 8, "isolated_outlier": 4, "cluster_outlier": 8}
    assert {r["label"] for r in world.select("label").distinct().collect()} == {"class_0", "class_1", "class_2", "class_3", "ambiguous"}


def test_uploads(spark):
    w, text = Workbench(spark), b"object_id,p_a,p_b\nx,0.25,0.75\ny,0.5,0.5\n"
    got = w.import_upload(text, "up.csv")
    assert got["n_objects"] == 2 and got["dataset_key"].startswith("imported_") and got["dataset_key"] in w.datasets()
    assert w.import_upload(text, "up.TXT", "named")["dataset_key"] == "named"
    for bad in (lambda: w.import_upload(text, "up.exe"), lambda: w.import_upload(b"x" * (11 << 20), "up.csv")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ImportValidationError):
        w.import_upload(text, "up.parquet")


def test_entry_and_drawn_edges(spark):
    w = Workbench(spark)
    e = w.entry("calibration_3class")
    assert set(e["representations"]) == {"probability", "sqrt_probability", "clr_probability"} and e["n_objects"] == 15
    means = lambda df: df.groupBy().avg("x", "y").first()
    assert abs(means(e["views"]["pca_corners"]["coordinates"])[0]) < 1e-9
    p = e["representations"]["probability"]
    at = {r["object_id"]: (r["x"], r["y"]) for r in p["coordinates"].collect()}
    assert at["corner_0"] == pytest.approx(tuple(p["basis"][0]))  # uncentred
    assert {r["colour"] for r in e["colours"].collect()} <= {"hsl(0, 65%, 50%)", "hsl(138, 65%, 50%)", "hsl(275, 65%, 50%)"}
    edges = w.topology_drawn(view_id="collapsed_bridge")
    assert edges.columns == ["source", "target", "type", "x1", "y1", "x2", "y2"] and edges.count() == w.topology(view_id="collapsed_bridge").count()


def test_benchmark_tables(spark, tmp_path, capsys):
    r = np.random.default_rng(3)
    rows = [(*(float(x) for x in r.normal(0, 1, 2) + 5 * np.eye(3)[i % 3][:2]), f"kind{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "length double, width double, target string").coalesce(1).write.csv(str(tmp_path / "iris.csv"), header=True)
    points, classes, objects = datasets.fetch(spark, "iris_3class", str(tmp_path / "iris.csv"))
    assert points.count() == 60 and classes == ["kind0", "kind1", "kind2"] and objects.where("correct").count() > 50
    digits = spark.createDataFrame([(*(int(x) for x in r.integers(0, 17, 4)), i % 10) for i in range(40)], "a int, b int, c int, d int, target int")
    digits.coalesce(1).write.parquet(str(tmp_path / "digits.parquet"))
    _, classes, objects = datasets.fetch(spark, "digits_10class", str(tmp_path / "digits.parquet"))
    assert classes[0] == "digit_0" and all(bytes(r[0]).startswith(b"P5 2 2 255\n") and len(r[0]) == 15 for r in objects.select("payload_image_bytes").collect())
    out = str(tmp_path / "bundle")
    assert cli.main(["datasets", "fetch", "iris_3class", "--table", str(tmp_path / "iris.csv"), "--output", out]) == 0 and cli.main(["validate-bundle", out]) == 0
    assert cli.main(["datasets", "fetch", "iris_3class"]) == 1 and cli.main(["datasets", "info", "wine_3class"]) == 0
    with pytest.raises(ImportValidationError):
        datasets.fetch(spark, "wine_3class", str(tmp_path / "digits.parquet"))
    with pytest.raises(ValueError):
        datasets.fetch(spark, "apparel", str(tmp_path / "iris.csv"))
