"""Command line: generate and validate bundles, import files, list datasets."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.errors import BundleError, ImportValidationError
from planewise.functions import vectors
from planewise.sources import datasets, fixtures, generators, imports, populations
from planewise.sources.bundle import BundleWriter, Manifest, RepresentationSpec, validate_bundle

GENERATED = {
    "calibration": lambda s, n, seed: (fixtures.calibration(s), 3), "synthetic": lambda s, n, seed: (generators.synthetic(s, n, seed), 4), "apparel": lambda s, n, seed: (generators.apparel(s, n, seed), 10),
    "belief_world": lambda s, n, seed: (populations.belief_world(s, n, seed), 4), "apparel_world": lambda s, n, seed: (populations.apparel_world(s, n, seed), 10)}


def session() -> SparkSession:
    return SparkSession.builder.appName("planewise").getOrCreate()


def write_bundle(path: str, name: str, points: DataFrame, features: list[str], objects: DataFrame | None = None) -> Manifest:
    """Probabilities and their centred log ratios as a bundle."""
    if objects is None:
        predicted = vectors.argmax_label(F.col("vec"), [f"class_{i}" for i in range(len(features))])
        objects = points.select("object_id", "pos", F.col("label").alias("true_label"), predicted.alias("predicted_label"), vectors.correct(F.col("label"), predicted).alias("correct"), vectors.entropy(F.col("vec")).alias("entropy"), *(["generator_component"] if "generator_component" in points.columns else []))
    writer = BundleWriter(path, name).set_objects(objects)
    writer.add_representation(points, RepresentationSpec("probability", "representations/probability.parquet", len(features), features, ["finite", "nonnegative", "row_sum_1"], compatible_metrics=["euclidean", "hellinger", "fisher_rao", "aitchison", "jensen_shannon"], default_metric="fisher_rao"))
    clr = points.withColumn("vec", vectors.clr(F.col("vec")))
    writer.add_representation(clr, RepresentationSpec("clr_probability", "representations/clr_probability.parquet", len(features), [f"clr_{f}" for f in features], ["finite", "row_sum_0"], compatible_metrics=["euclidean"], default_metric="euclidean"))
    return writer.write()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="planewise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="write a generated bundle")
    g.add_argument("kind", choices=sorted(GENERATED))
    g.add_argument("--output", required=True)
    g.add_argument("--samples", type=int, default=2000)
    g.add_argument("--seed", type=int, default=20260801)
    v = sub.add_parser("validate-bundle", help="check a bundle")
    v.add_argument("path")
    for kind in ("csv", "parquet"):
        i = sub.add_parser(f"import-{kind}", help=f"import a {kind} file as a bundle")
        i.add_argument("path")
        i.add_argument("--output", required=True)
        i.add_argument("--id-column")
        i.add_argument("--label-column")
        i.add_argument("--features", nargs="*")
        i.add_argument("--classes", type=int)
        i.add_argument("--softmax", action="store_true")
        i.add_argument("--name", default="imported")
    d = sub.add_parser("datasets", help="built-in datasets")
    d.add_argument("action", choices=["list", "info", "fetch"])
    d.add_argument("name", nargs="?")
    d.add_argument("--table", help="a CSV or Parquet copy of the dataset's table, for fetch")
    d.add_argument("--label-column", default="target")
    d.add_argument("--output", help="the bundle to write, for fetch")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if a.command == "generate":
            points, k = GENERATED[a.kind](session(), a.samples, a.seed)
            write_bundle(a.output, a.kind, points, [f"p{i}" for i in range(k)])
            print(f"wrote {a.output}")
        elif a.command == "validate-bundle":
            found = validate_bundle(session(), a.path)
            print("\n".join([*(f"error: {e}" for e in found.errors), *(f"warning: {w}" for w in found.warnings)]) or "valid")
            return int(not found.is_valid)
        elif a.command.startswith("import-"):
            kind = a.command.removeprefix("import-")
            got = imports.import_frame(imports.read(session(), a.path, kind), a.id_column, a.label_column, a.features, a.classes, a.softmax)
            write_bundle(a.output, a.name, got.points, got.features, got.objects)
            print(f"wrote {a.output}")
        elif a.action == "list":
            print("\n".join(f"{s.key}: {s.title}, {s.n_classes} classes, {s.source}" for s in datasets.REGISTRY.values()))
        elif a.action == "fetch":
            if a.name not in datasets.REGISTRY or not a.table or not a.output:
                raise ValueError("fetch needs a known dataset, --table and --output")
            points, classes, objects = datasets.fetch(session(), a.name, a.table, a.label_column)
            write_bundle(a.output, a.name, points, classes, objects)
            print(f"wrote {a.output}")
        elif a.name in datasets.REGISTRY:
            spec = datasets.REGISTRY[a.name]
            print(f"{spec.key}: {spec.title}, {spec.n_classes} classes, {spec.source}")
            if a.name in GENERATED:
                print(f"{GENERATED[a.name](session(), 200, 42)[0].count()} objects")
        else:
            print(f"unknown dataset {a.name!r}", file=sys.stderr)
            return 1
    except (BundleError, ImportValidationError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
