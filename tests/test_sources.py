"""Imports, bundles, the SQLite source, records, workbench, command line and streams."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise import cli
from planewise.errors import BundleError, CompatibilityError, ImportValidationError
from planewise.functions import colours
from planewise.functions.metrics import REGISTRY
from planewise.operators import neighbors, selection
from planewise.operators.pairs import pairs, space
from planewise.records import InvestigationRecord
from planewise.sources import datasets, fixtures, imports
from planewise.sources.bundle import BundleReader, BundleWriter, RepresentationSpec, check_version, file_sha256, validate_bundle
from planewise.sources.sqlite_bundle import SQLiteBundleReader, SQLiteBundleWriter
from planewise.streaming.composition import compositions
from planewise.workbench import Workbench

CSV = "object_id,true_label,p0,p1,p2\na,p0,0.7,0.2,0.1\nb,p1,0.1,0.8,0.1\nc,p2,0.2,0.2,0.6\nd,p0,0.3,0.4,0.3\ne,p1,0.0,1.0,0.0\n"


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "sample.csv"
    p.write_text(CSV)
    return str(p)


def test_import_csv(spark, csv):
    got = imports.import_frame(imports.read(spark, csv, "csv"), label_column="true_label")
    assert got.features == ["p0", "p1", "p2"]
    rows = {r["object_id"]: r for r in got.objects.collect()}
    assert [rows[i]["pos"] for i in "abcde"] == [0, 1, 2, 3, 4] and rows["a"]["predicted_label"] == "p0"
    assert rows["e"]["entropy"] == 0 and rows["b"]["confidence"] == pytest.approx(0.8)


def test_import_without_ids_and_with_softmax(spark, tmp_path):
    df = spark.createDataFrame([(float(i), -float(i), 0.5) for i in range(23)], "x double, y double, z double").repartition(5)
    with pytest.raises(ImportValidationError, match="negative"):
        imports.import_frame(df)
    got = imports.import_frame(df, softmax=True)
    rows = got.points.collect()
    assert sorted(r["object_id"] for r in rows) == sorted(f"obj_{i}" for i in range(23)) and all(abs(sum(r["vec"]) - 1) < 1e-12 for r in rows)


@pytest.mark.parametrize(("rows", "schema", "options", "match"), [
    ([], "a double, b double", {}, "no rows"),
    ([(1.0,)], "a double", {}, "two feature columns"),
    ([(0.5, 0.5)], "a double, b double", {"n_classes": 3}, "3 classes"),
    ([(0.5, float("nan"))], "a double, b double", {}, "finite"),
    ([(0.5, None)], "a double, b double", {}, "finite"),
    ([(0.5, 0.6)], "a double, b double", {}, "sum to 1"),
    ([("x", 0.6)], "a string, b double", {}, "aren't numbers"),
    ([(0.5, 0.5)], "a double, b double", {"id_column": "q"}, "no column"),
])
def test_import_validation(spark, rows, schema, options, match):
    with pytest.raises(ImportValidationError, match=match):
        imports.import_frame(spark.createDataFrame(rows, schema), **options)


def test_stratified(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS c")
    got = imports.stratified(df, "c", 100)
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {0: 90, 1: 10}
    assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in imports.stratified(df.repartition(3), "c", 100).select("id").collect())


def test_bundle_round_trip_and_faults(spark, tmp_path):
    path = str(tmp_path / "bundle")
    points = fixtures.calibration(spark)
    cli.write_bundle(path, "cal", points, ["p0", "p1", "p2"])
    assert validate_bundle(spark, path).is_valid
    reader = BundleReader(spark, path)
    assert sorted((r["object_id"], tuple(r["vec"])) for r in reader.points("probability").collect()) == sorted((n, v) for n, v in fixtures.CALIBRATION)
    assert reader.spec("clr_probability").constraints == ["finite", "row_sum_0"]
    with pytest.raises(KeyError):
        reader.points("nope")

    def faulty(change):
        spark.createDataFrame(change(points).collect(), points.schema).createOrReplaceTempView("p")
        other = str(tmp_path / f"b{abs(hash(change))}")
        w = BundleWriter(other, "x").set_objects(points.select("object_id", "pos"))
        w.add_representation(spark.table("p"), RepresentationSpec("r", "r.parquet", 3, ["a", "b", "c"], ["finite", "nonnegative", "row_sum_1"]))
        w.write()
        return " ".join(validate_bundle(spark, other).errors)

    assert faulty(lambda p: p) == ""
    assert "another order" in faulty(lambda p: p.withColumn("pos", 14 - F.col("pos")))
    assert "row_sum_1" in faulty(lambda p: p.withColumn("vec", F.transform("vec", lambda x: x * 2)))
    assert "number of rows" in faulty(lambda p: p.where("pos > 0")) and "ids differ" in faulty(lambda p: p.where("pos > 0"))
    assert "repeat" in faulty(lambda p: p.unionByName(p.limit(1)))
    points.select("object_id", "pos", F.lit(1.0).alias("p0"), F.lit(0.0).alias("p1"), F.lit(0.0).alias("p2")).write.mode("overwrite").parquet(f"{path}/representations/probability.parquet")
    assert validate_bundle(spark, path).errors == ["probability: the hash differs"]
    with pytest.raises(BundleError):
        BundleReader(spark, path)
    assert not validate_bundle(spark, str(tmp_path / "missing")).is_valid
    with pytest.raises(BundleError, match="isn't unique"):
        BundleWriter(path, "x").set_objects(points.unionByName(points))
    with pytest.raises(BundleError):
        BundleWriter(path, "x").add_view({"kind": "embedding"})
    assert check_version("0.9.0") and not check_version("0.1.7")
    with pytest.raises(BundleError):
        check_version("1.0.0")


def test_file_hash(tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 50_000)
    import hashlib

    assert file_sha256(str(tmp_path / "f")) == hashlib.sha256(b"abc" * 50_000).hexdigest()


def test_sqlite_bundle(spark, tmp_path):
    path = str(tmp_path / "b.db")
    points = fixtures.calibration(spark)
    edges = neighbors.knn(pairs(space(points, "vec", 3, REGISTRY.get("euclidean"))), 3)
    objects = points.select("object_id", "pos", F.col("label").alias("true_label"), F.lit(None).cast("string").alias("pred_label"), F.lit(7).alias("extra"), F.lit(b"\x89PNG").alias("payload"))
    w = SQLiteBundleWriter(path, "cal", "d")
    w.set_objects(objects).add_representation("probability", points).add_knn_graph("probability", "euclidean", edges)
    w.add_catalog_view("v", "probability", np.eye(3)[:, :2]).add_catalog_view("v", "clr", np.eye(3)[:, 1:])
    w.add_view_coords("v", "probability", points.select("object_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))).finalize()
    r = SQLiteBundleReader(spark, path)
    assert r.get_manifest()["bundle_id"] == "cal" and r.object_ids() == [n for n, _ in fixtures.CALIBRATION]
    one = r.objects().where("object_id = 'center'").first()
    assert one["pred_label"] is None and bytes(one["payload"]) == b"\x89PNG" and json.loads(one["json_meta"]) == {"extra": 7}
    assert (r.matrix("probability") == np.array([v for _, v in fixtures.CALIBRATION])).all()
    near = {x["src_id"]: x["neighbors"] for x in r.neighbors("probability", "euclidean", 2).collect()}
    assert near["corner_0"] == ["interior_00", "interior_03"]
    assert (r.view_basis("v", "clr") == np.eye(3)[:, 1:]).all() and r.view_coords("v", "probability").count() == 15
    with pytest.raises(KeyError):
        r.view_basis("w", "clr")
    with sqlite3.connect(path) as db:
        db.execute("UPDATE representation_blobs SET sha256 = 'x'")
    with pytest.raises(ValueError):
        r.matrix("probability")
    with pytest.raises(FileNotFoundError):
        SQLiteBundleReader(spark, path + "x")


def test_workbench(spark, csv, tmp_path):
    w = Workbench(spark)
    d = w.diagnostics(target_id="midpoint_01", view_id="collapsed_bridge")
    assert d["preserved"] == ["interior_00"] and set(d["torn"]) == {"interior_03", "interior_06"} and d["false_neighbors"] == ["corner_0", "corner_1"]
    assert (d["trustworthiness"], d["continuity"], d["stress"]) == (0.7178, 0.8622, 0.4460)
    assert w.diagnostics()["trustworthiness"] == 1.0
    assert w.topology(view_id="collapsed_bridge").count() > 0
    g = w.distortion_grid(resolution=4)
    assert len(g["grid"]) == 8 and g["bounds"]["xMin"] < g["bounds"]["xMax"]
    assert w.subspace_angles(view_a="pca_corners", view_b="pca_corners")["interpretation"] == "tight"
    s = w.point_stability(k=3)
    assert s["scores"].count() == 15 and 0 <= s["mean_stability"] <= 1
    assert w.fixture("calibration_3class").count() == 15 and w.object_payload("calibration_3class", "center") is None
    got = w.import_dataset(csv, label_column="true_label")
    assert got == {"dataset_key": "sample", "n_objects": 5, "n_classes": 3} and "sample" in w.datasets()
    for wrong in (lambda: w.diagnostics(k=15), lambda: w.diagnostics(representation="x"), lambda: w.diagnostics(target_id="x"), lambda: w.diagnostics(view_id="x"), lambda: w.diagnostics(metric="aitchison", representation="clr_probability"), lambda: w.import_dataset("a.exe")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        w.diagnostics(dataset="nope")
    assert w.health()["vector_index"] is False and w.status()["saved_views"] == 0


def test_records(spark):
    w = Workbench(spark)
    v = w.save_view("first", "calibration_3class", note="n")
    text = w.export_record("calibration_3class", "s").to_json()
    w.delete_view(v.id)
    assert w.saved_views() == [] and w.import_record(text).saved_views[0] == v and w.saved_views() == [v]
    raw = json.loads(text)
    raw["artifact_hashes"]["matrix"] = "x"
    with pytest.raises(CompatibilityError):
        w.import_record(json.dumps(raw))
    with pytest.raises(ValueError):
        InvestigationRecord.from_json("[]")
    with pytest.raises(KeyError):
        w.delete_view("x")
    assert "| trustworthiness | 1.0 |" in w.report("calibration_3class")
    assert w.pca("calibration_3class").basis.shape == (3, 2)


def test_command_line(spark, csv, tmp_path, capsys):
    out = str(tmp_path / "b")
    assert cli.main(["import-csv", csv, "--output", out, "--label-column", "true_label"]) == 0
    assert cli.main(["validate-bundle", out]) == 0 and cli.main(["validate-bundle", out + "x"]) == 1
    assert cli.main(["generate", "calibration", "--output", str(tmp_path / "c")]) == 0
    assert cli.main(["datasets", "list"]) == 0 and cli.main(["datasets", "info", "apparel"]) == 0 and cli.main(["datasets", "info", "x"]) == 1
    assert "10 classes" in capsys.readouterr().out
    assert cli.main(["import-csv", csv, "--output", out, "--classes", "9"]) == 1


def test_discovery_and_registry(spark, tmp_path):
    cli.write_bundle(str(tmp_path / "good"), "good", fixtures.calibration(spark), ["p0", "p1", "p2"])
    (tmp_path / "other").mkdir()
    w = Workbench(spark)
    assert w.discover(str(tmp_path)) == ["good"] and w.discover(str(tmp_path / "none")) == []
    assert w.diagnostics(dataset="good", target_id="midpoint_01", view_id="collapsed_bridge")["preserved"] == ["interior_00"]
    assert json.loads(w.fixture_json("good").first()["json"]).keys() == {"object_id", "label", "vec", "x", "y"}
    assert datasets.REGISTRY["apparel"].n_classes == 10
    assert datasets.neighbours_in_order(fixtures.calibration(spark), "corner_0") == ("interior_07", "corner_1")


def test_baseline_classifier(spark):
    r = np.random.default_rng(2)
    rows = [(f"o{i}", f"c{i % 3}", (r.normal(0, 1, 3) + 4 * np.eye(3)[i % 3]).tolist()) for i in range(90)]
    beliefs, classes = datasets.fit_baseline(spark.createDataFrame(rows, "object_id string, label string, vec array<double>"))
    got = datasets.point_metadata(beliefs, classes).collect()
    assert classes == ["c0", "c1", "c2"] and np.mean([x["correct"] for x in got]) > 0.95 and max(x["confidence"] for x in got) > 0.9


def test_colours(spark):
    df = spark.createDataFrame([("corner_1", 0), ("midpoint", 11), ("other", 2)], "name string, code int")
    got = df.select(colours.by_prefix(F.col("name"), {"corner": "red"}, colours.by_substring(F.col("name"), {"point": "blue"}, F.lit("grey"))).alias("c"), colours.by_index(F.col("code"), colours.palette(10)).alias("i"), colours.by_name(F.col("name")).alias("n")).collect()
    assert [r["c"] for r in got] == ["red", "blue", "grey"] and [r["i"] for r in got] == [colours.palette(10)[k] for k in (0, 1, 2)]
    assert all(r["n"].startswith("hsl(") for r in got)


def test_selections(spark):
    p = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.9, "x"), ("b", 1, 1.0, 1.0, 0.5, "y"), ("c", 2, 0.1, 0.0, 0.7, "x")], "object_id string, pos long, x double, y double, confidence double, predicted_label string")
    inside = selection.marquee(p, 0.5, 0.0, 0.0, 0.5)
    assert selection.selection_summary(inside).first().asDict() == {"n": 2, "mean_confidence": 0.8, "classes": "x"}
    assert selection.selection_summary(selection.marquee(p, 1, 1, 1, 1)).collect() == []
    assert selection.hit(p, 0, 0, 0.2).first()["object_id"] == "c"
    assert [r[0] for r in p.select(selection.step(F.col("pos"), 1, 3)).collect()] == [1, 2, 0] and p.select(selection.step(F.col("pos"), -1, 3)).first()[0] == 2
    with pytest.raises(ValueError):
        selection.lookup(p, "z")


def test_streaming_composition_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.limit(400).write.parquet(str(tmp_path / "in"))
    kinds = ("click", "error", "purchase", "signup", "view")
    stream = compositions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), kinds)
    q = stream.writeStream.format("memory").queryName("shares").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = compositions(spark.read.parquet(str(tmp_path / "in")), kinds)
    key = lambda r: (r["window_start"], r["object_id"], r["n"], tuple(r["vec"]))
    assert sorted(map(key, spark.table("shares").collect())) == sorted(map(key, want.collect()))


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The entry, its queries and its oracles stand on their own."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "planewise", tmp_path / "planewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin"})
