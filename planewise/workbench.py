"""The service surface: datasets by name and every analysis as a method with plain parameters.

Unknown datasets raise KeyError; bad k, representations, views and targets ValueError.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import colours
from planewise.functions.metrics import REGISTRY, represent
from planewise.operators import blocks, diagnostics, neighbors, projection, selection
from planewise.operators.moments import moments, moments_by
from planewise.operators.pairs import pairs, space
from planewise.plans import bases, rashomon, tours
from planewise.plans.catalog import CatalogView, catalog
from planewise.records import InvestigationRecord, SavedView, check_replay, hashes, markdown
from planewise.sources import fixtures, generators, imports
from planewise.sources.bundle import BundleReader, discover


@dataclass
class Dataset:
    """Points (object_id, pos, label, vec) of one dataset with the names of its features."""

    key: str
    points: DataFrame
    features: list[str]
    objects: DataFrame | None = None

    @property
    def dimension(self) -> int:
        return len(self.features)


class Workbench:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._data: dict[str, Dataset] = {}
        self._views: dict[tuple[str, str], dict[str, CatalogView]] = {}
        self._saved: dict[str, SavedView] = {}
        self._built_in = {
            "calibration_3class": lambda: (fixtures.calibration(spark), 3),
            "synthetic_4class": lambda: (generators.synthetic(spark, 100, 42), 4),
            "fashion_mnist": lambda: (generators.apparel(spark), 10),
        }

    # -- datasets ----

    def datasets(self) -> list[str]:
        return [*self._built_in, *(k for k in self._data if k not in self._built_in)]

    def dataset(self, key: str) -> Dataset:
        if key not in self._data:
            if key not in self._built_in:
                raise KeyError(f"unknown dataset {key!r}")
            points, k = self._built_in[key]()
            self.add(key, points, [f"p{i}" for i in range(k)])
        return self._data[key]

    def add(self, key: str, points: DataFrame, features: list[str], objects: DataFrame | None = None) -> Dataset:
        """Points are kept in memory or, where they don't fit, on disk."""
        self._data[key] = Dataset(key, points.persist(StorageLevel.MEMORY_AND_DISK), features, objects)
        self._views = {k: v for k, v in self._views.items() if k[0] != key}
        return self._data[key]

    def import_dataset(self, path: str, dataset_name: str | None = None, **options: Any) -> dict[str, Any]:
        """A CSV or Parquet file of at most ``MAX_UPLOAD_BYTES``."""
        kind = imports.EXTENSIONS.get(os.path.splitext(path)[1].lower())
        if kind is None:
            raise ValueError(f"files end in {', '.join(imports.EXTENSIONS)}")
        if os.path.isfile(path) and os.path.getsize(path) > imports.MAX_UPLOAD_BYTES:
            raise ValueError("the file is too large")
        return self._imported(imports.read(self.spark, path, kind), dataset_name or os.path.splitext(os.path.basename(path))[0], options)

    def import_upload(self, content: bytes, filename: str, dataset_name: str | None = None, **options: Any) -> dict[str, Any]:
        """The bytes of a CSV or Parquet file; without a name for the dataset it gets one of its own."""
        kind = imports.EXTENSIONS.get(os.path.splitext(filename)[1].lower())
        if kind is None:
            raise ValueError(f"files end in {', '.join(imports.EXTENSIONS)}")
        if len(content) > imports.MAX_UPLOAD_BYTES:
            raise ValueError("the file is too large")
        return self._imported(imports.from_bytes(self.spark, content, kind), dataset_name or f"imported_{uuid.uuid4().hex[:6]}", options)

    def _imported(self, df: DataFrame, key: str, options: dict[str, Any]) -> dict[str, Any]:
        got = imports.import_frame(df, **options)
        d = self.add(key, got.points, got.features, got.objects)
        return {"dataset_key": key, "n_objects": d.points.count(), "n_classes": d.dimension}

    def status(self) -> dict[str, Any]:
        return {"datasets": self.datasets(), "loaded": sorted(self._data), "saved_views": len(self._saved)}

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "spark": self.spark.version, "metrics": REGISTRY.ids(), "vector_index": False}

    def object_payload(self, dataset: str, object_id: str) -> bytes | None:
        d = self.dataset(dataset)
        row = selection.lookup(d.objects if d.objects is not None else d.points, object_id).first()
        held = row.asDict().get("payload_image_bytes")
        return bytes(held) if held is not None else None

    def entry(self, dataset: str) -> dict[str, Any]:
        """What a client loads of a dataset: of each representation its principal plane and, lazily, uncentred coordinates; of each catalogue view the centred ones; and colours by class."""
        d = self.dataset(dataset)
        representations = {}
        for name in ("probability", "sqrt_probability", "clr_probability"):
            points = self._points(dataset, name)
            basis, values = bases.pca(moments(points, d.dimension))
            representations[name] = {"basis": basis, "eigenvalues": [float(x) for x in values[:2]], "centering": "mean_centered", "coordinates": projection.project(points, basis).select("object_id", "x", "y")}
        views = {}
        for v in self.views(dataset).values():
            views[v.view_id] = {"title": v.title, "basis": v.basis, "misleading": v.misleading, "valid": v.valid, "coordinates": self._projected(d.points, v.basis, d.dimension).select("object_id", "x", "y")}
        # The class is that of the label if a feature is called so, else the largest entry.
        codes = {f: i for i, feature in enumerate(d.features) for f in (feature, feature.removeprefix("p_"))}
        named = F.try_element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.col("label"))
        code = F.coalesce(named, F.array_position("vec", F.array_max("vec")).cast("int") - 1)
        return {"key": dataset, "features": d.features, "n_objects": d.points.count(), "representations": representations, "views": views, "colours": d.points.select("object_id", colours.by_index(code, colours.palette(max(d.dimension, 1))).alias("colour"))}

    def fixture(self, dataset: str) -> DataFrame:
        """Every object with its centred PCA coordinates, as JSON-ready rows."""
        d, view = self.dataset(dataset), self._view(dataset, "probability", "pca_corners")
        return self._projected(d.points, view, d.dimension).select("object_id", "pos", "label", "vec", "x", "y")

    def fixture_json(self, dataset: str) -> DataFrame:
        """The same as one JSON text a row, written wherever the rows go."""
        return self.fixture(dataset).select(F.to_json(F.struct("object_id", "label", "vec", "x", "y")).alias("json"))

    def discover(self, directory: str) -> list[str]:
        """Adds the valid bundles of a folder that aren't loaded yet, and returns their names."""
        found = discover(self.spark, directory)
        for name, path in found.items():
            if name not in self._data and name not in self._built_in:
                reader = BundleReader(self.spark, path, check=False)
                objects = reader.objects()
                points = reader.points("probability").join(objects.select("object_id", F.col("true_label").alias("label")), "object_id")
                self.add(name, points, reader.spec("probability").feature_columns, objects)
        return list(found)

    # -- helpers ----

    def _points(self, dataset: str, representation: str) -> DataFrame:
        d = self.dataset(dataset)
        try:
            transform = represent(representation)
        except KeyError:
            raise ValueError(f"unknown representation {representation!r}") from None
        return d.points.withColumn("vec", transform(F.col("vec")))

    def views(self, dataset: str, representation: str = "probability") -> dict[str, CatalogView]:
        key = (dataset, representation)
        if key not in self._views:
            self._views[key] = catalog(self._points(dataset, representation), self.dataset(dataset).dimension)
        return self._views[key]

    def _view(self, dataset: str, representation: str, view_id: str) -> np.ndarray:
        found = self.views(dataset, representation)
        if view_id not in found:
            raise ValueError(f"unknown view {view_id!r}; there are {', '.join(found)}")
        return found[view_id].basis

    @staticmethod
    def _projected(points: DataFrame, basis: np.ndarray, dimension: int) -> DataFrame:
        return projection.project(points, basis, centre=projection.column_means(points, dimension))

    def _pairs(self, dataset: str, representation: str, metric: str, view_id: str, target: str | None = None) -> tuple[DataFrame, DataFrame, int]:
        d = self.dataset(dataset)
        points = self._points(dataset, representation)
        basis = self._view(dataset, representation, view_id)
        m = REGISTRY.compatible(metric, representation)
        v = F.col("vec")
        s = space(points, "vec", d.dimension, m, (projection.along(v, basis[:, 0]), projection.along(v, basis[:, 1])), ["pos", "label"])
        return pairs(s, target), s.frame, d.points.count()

    def _near(self, dataset: str, representation: str, metric: str, view_ids: list[str], k: int, target: str | None = None, **settings: Any) -> tuple[DataFrame, int]:
        """Neighbours and ranks by blocks of points, in the planes of the given views; and the number of points."""
        d = self.dataset(dataset)
        m, v = REGISTRY.compatible(metric, representation), F.col("vec")
        bases_ = [self._view(dataset, representation, x) for x in view_ids]
        placed = blocks.placed(self._points(dataset, representation), "vec", d.dimension, m, [(projection.along(v, b[:, 0]), projection.along(v, b[:, 1])) for b in bases_])
        n = placed.count()
        self._check_k(k, n)
        return blocks.neighbours(placed, d.dimension, m, len(view_ids), k, target, count=n, **settings), n

    def _check_k(self, k: int, n: int) -> None:
        if not 1 <= k < n:
            raise ValueError(f"k must be between 1 and {n - 1}")

    # -- analyses ----

    def diagnostics(self, dataset: str = "calibration_3class", target_id: str | None = None, representation: str = "probability", metric: str = "euclidean", view_id: str = "pca_corners", k: int = 3) -> dict[str, Any]:
        d = self.dataset(dataset)
        target_id = target_id or d.points.orderBy("pos").first()["object_id"]
        selection.lookup(d.points, target_id)
        every, n = self._near(dataset, representation, metric, [view_id], k, sums=True)
        whole = diagnostics.summary_of_blocks(every, n, k).first()
        one, _ = self._near(dataset, representation, metric, [view_id], k, target_id)
        near = neighbors.classes(neighbors.block_ranks(one), k).collect()
        of = lambda kind, rank: [r["neighbor_id"] for r in sorted(near, key=lambda r: r[rank]) if r["class"] == kind]
        p, t, f = of("preserved", "source_rank"), of("torn", "source_rank"), of("false", "view_rank")
        share = lambda a, b: round(a / b, 4) if b else 1.0
        return {
            "preserved": p, "torn": t, "false_neighbors": f, "precision": share(len(p), len(p) + len(f)), "recall": share(len(p), len(p) + len(t)), "jaccard_overlap": share(len(p), len(p) + len(t) + len(f)),
            **{name: round(whole[name], 4) for name in ("trustworthiness", "continuity", "stress")},
        }

    def topology(self, dataset: str = "calibration_3class", representation: str = "probability", metric: str = "euclidean", view_id: str = "pca_corners", k: int = 3) -> DataFrame:
        near, _ = self._near(dataset, representation, metric, [view_id], k)
        return neighbors.topology(neighbors.classes(neighbors.block_ranks(near), k))

    def topology_drawn(self, dataset: str = "calibration_3class", representation: str = "probability", metric: str = "euclidean", view_id: str = "pca_corners", k: int = 3) -> DataFrame:
        """The edges with the coordinates of both ends in the view, as they are drawn."""
        d = self.dataset(dataset)
        placed = self._projected(self._points(dataset, representation), self._view(dataset, representation, view_id), d.dimension)
        return neighbors.drawn(self.topology(dataset, representation, metric, view_id, k), placed)

    def distortion_grid(self, dataset: str = "calibration_3class", representation: str = "probability", metric: str = "euclidean", view_id: str = "pca_corners", resolution: int = 32) -> dict[str, Any]:
        d, m, v = self.dataset(dataset), REGISTRY.compatible(metric, representation), F.col("vec")
        basis = self._view(dataset, representation, view_id)
        whole = blocks.placed(self._points(dataset, representation), "vec", d.dimension, m, [(projection.along(v, basis[:, 0]), projection.along(v, basis[:, 1]))])
        placed = whole.select("object_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
        box = diagnostics.bounds(placed)
        n = max(8, min(64, resolution))
        cells = {(r["row"], r["col"]): r["mean_distortion"] for r in diagnostics.grid(placed.join(diagnostics.distortion_of_blocks(whole, d.dimension, m), "object_id"), box, n).collect()}
        return {"grid": [[cells.get((i, j)) for j in range(n)] for i in range(n)], "bounds": box}

    def subspace_angles(self, dataset: str = "calibration_3class", representation: str = "probability", view_a: str = "pca_corners", view_b: str = "fisher_lda") -> dict[str, Any]:
        t = np.degrees(bases.principal_angles(self._view(dataset, representation, view_a), self._view(dataset, representation, view_b)))
        far = float(np.hypot(*t))
        return {"theta_1_deg": round(float(t[0]), 2), "theta_2_deg": round(float(t[1]), 2), "grassmannian_dist_deg": round(far, 2), "interpretation": diagnostics.angle_label(far)}

    def tour_path(self, dataset: str = "calibration_3class", representation: str = "probability", n_frames: int = 180) -> DataFrame:
        return tours.grand_tour(self._points(dataset, representation), self.dataset(dataset).dimension, n_frames)

    def optimize_view(self, dataset: str = "calibration_3class", representation: str = "probability", criterion: str = "class_separation", target_id: str | None = None, n_frames: int = 60) -> tours.GuidedView:
        d = self.dataset(dataset)
        if criterion == "neighborhood_integrity":
            target_id = target_id or d.points.orderBy("pos").first()["object_id"]
            selection.lookup(d.points, target_id)
        return tours.guided_view(self._points(dataset, representation), d.dimension, criterion, target_id, n_frames)

    def point_stability(self, dataset: str = "calibration_3class", representation: str = "probability", metric: str = "euclidean", k: int = 5) -> dict[str, Any]:
        """Summary, and ``scores`` as a DataFrame (object_id, stability): the share of source neighbours that the catalogue's views keep."""
        found = list(self.views(dataset, representation))
        near, _ = self._near(dataset, representation, metric, found, k, ranks=())
        scores = diagnostics.stability_of_blocks(near, len(found), k)
        return {**diagnostics.stability_summary(scores).first().asDict(), "scores": scores.withColumn("stability", neighbors.result(F.col("stability"), 4))}

    def rashomon_set(self, dataset: str = "calibration_3class", representation: str = "probability", view_id: str = "pca_corners", threshold: float = 0.5) -> list[rashomon.Candidate]:
        d = self.dataset(dataset)
        return rashomon.rashomon_set(self._points(dataset, representation), d.dimension, self._view(dataset, representation, view_id), threshold=threshold)

    def discriminative_basis(self, dataset: str, representation: str = "probability") -> np.ndarray:
        """Fisher's plane of the given labels; a constant label says nothing and leaves the principal plane."""
        d = self.dataset(dataset)
        return bases.discriminant_plane(moments_by(self._points(dataset, representation), d.dimension))

    def pca(self, dataset: str, representation: str = "probability") -> bases.FittedView:
        d = self.dataset(dataset)
        basis, values = bases.pca(moments(self._points(dataset, representation), d.dimension))
        return bases.FittedView("pca_corners", representation, basis, d.features, hashes(d.points, d.features)["id_tree"], [float(x) for x in values[:2]])

    # -- records ----

    def save_view(self, name: str, dataset: str, representation_id: str = "probability", metric_id: str = "euclidean", k: int = 3, view_id: str = "pca_corners", target_id: str | None = None, note: str = "") -> SavedView:
        d = self.dataset(dataset)
        basis = self._view(dataset, representation_id, view_id)
        view = SavedView(name, representation_id, metric_id, k, view_id, target_id, note, metadata={"dataset": dataset, "basis": basis.tolist(), "hashes": hashes(d.points, d.features)})
        self._saved[view.id] = view
        return view

    def saved_views(self) -> list[SavedView]:
        return list(self._saved.values())

    def delete_view(self, id: str) -> None:
        if id not in self._saved:
            raise KeyError(f"no saved view {id!r}")
        del self._saved[id]

    def export_record(self, dataset: str, summary_note: str = "") -> InvestigationRecord:
        d = self.dataset(dataset)
        own = [v for v in self._saved.values() if v.metadata.get("dataset") == dataset]
        return InvestigationRecord(dataset, own, hashes(d.points, d.features), summary_note)

    def import_record(self, text: str) -> InvestigationRecord:
        """Restores a record's views if the data are those it was made from."""
        record = InvestigationRecord.from_json(text)
        d = self.dataset(record.bundle_id)
        check_replay(record, hashes(d.points, d.features), d.points)
        self._saved |= {v.id: v for v in record.saved_views}
        return record

    def report(self, dataset: str, **parameters: Any) -> str:
        facts = self.diagnostics(dataset, **parameters)
        return markdown(f"Projection report: {dataset}", {**parameters, **facts}, self.saved_views())
