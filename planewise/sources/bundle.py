"""Bundles: a folder of Parquet tables with a JSON manifest that declares and hashes them.

Part files aren't reproducible byte for byte, so each table has a content hash over its
rows, independent of their order, beside its row count.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.conventions import BUNDLE_VERSION, PROB_SUM_ATOL
from planewise.errors import BundleError
from planewise.operators.selection import constraint_counts, duplicate_ids, missing_ids, out_of_order

CONSTRAINTS = ("finite", "nonnegative", "row_sum_1", "row_sum_0")


def file_sha256(path: str) -> str:
    """SHA-256 of a local file, 64 KB at a time."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 16):
            h.update(part)
    return h.hexdigest()


def content_hash(df: DataFrame) -> str:
    """A hash of the multiset of rows: four 64-bit sums of slices of each row's SHA-256, added without overflow, and the count."""
    row = F.sha2(F.to_json(F.struct(*(F.base64(F.col(c)).alias(c) if t == "binary" else F.col(c) for c, t in sorted(df.dtypes))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


@dataclass
class RepresentationSpec:
    id: str
    path: str
    dimension: int
    feature_columns: list[str]
    constraints: list[str] = field(default_factory=list)
    object_id_column: str = "object_id"
    compatible_metrics: list[str] = field(default_factory=list)
    default_metric: str | None = None
    transform: dict[str, Any] = field(default_factory=dict)
    content_sha256: str = ""


@dataclass
class Manifest:
    bundle_id: str
    description: str = ""
    schema_version: str = BUNDLE_VERSION
    created_at: str = ""
    objects: dict[str, Any] = field(default_factory=dict)
    representations: list[RepresentationSpec] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)
    views: list[dict] = field(default_factory=list)
    paths: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    extra_artifacts: list[dict] = field(default_factory=list)


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


class BundleWriter:
    """Collects tables and specifications and writes them at once."""

    def __init__(self, path: str, bundle_id: str, description: str = "") -> None:
        self.path = path.rstrip("/")
        self.manifest = Manifest(bundle_id, description)
        self._objects: DataFrame | None = None
        self._tables: list[tuple[RepresentationSpec, DataFrame]] = []

    def set_objects(self, objects: DataFrame) -> BundleWriter:
        """BundleError where an id repeats."""
        twice = duplicate_ids(objects).limit(1).collect()
        if twice:
            raise BundleError(f"object id {twice[0]['object_id']!r} isn't unique")
        self._objects = objects
        return self

    def add_representation(self, points: DataFrame, spec: RepresentationSpec) -> BundleWriter:
        """``points`` (object_id, pos, vec) as a wide table of ``spec.feature_columns``."""
        if spec.dimension != len(spec.feature_columns):
            raise BundleError(f"{spec.id}: {spec.dimension} dimensions, {len(spec.feature_columns)} feature columns")
        unknown = set(spec.constraints) - set(CONSTRAINTS)
        if unknown:
            raise BundleError(f"unknown constraints: {', '.join(sorted(unknown))}")
        wide = points.select("object_id", "pos", *(F.col("vec")[k].alias(c) for k, c in enumerate(spec.feature_columns)))
        self._tables.append((spec, wide))
        return self

    def _add(self, kind: str, item: dict) -> BundleWriter:
        getattr(self.manifest, kind).append(item)
        return self

    def add_metric(self, item: dict) -> BundleWriter:
        return self._add("metrics", item)

    def add_view(self, item: dict) -> BundleWriter:
        needed = {"linear_projection": "basis_ref", "embedding": "coordinates_ref"}.get(item.get("kind", ""))
        if needed is None or not item.get(needed):
            raise BundleError(f"a view is a linear_projection with basis_ref or an embedding with coordinates_ref: {item}")
        return self._add("views", item)

    def add_path(self, item: dict) -> BundleWriter:
        return self._add("paths", item)

    def add_diagnostic(self, item: dict) -> BundleWriter:
        return self._add("diagnostics", item)

    def add_extra_artifact(self, item: dict) -> BundleWriter:
        return self._add("extra_artifacts", item)

    def write(self) -> Manifest:
        if self._objects is None:
            raise BundleError("there are no objects")
        spark = self._objects.sparkSession
        self._objects.write.mode("overwrite").parquet(f"{self.path}/objects.parquet")
        back = spark.read.parquet(f"{self.path}/objects.parquet")
        self.manifest.objects = {"path": "objects.parquet", "object_count": back.count(), "content_sha256": content_hash(back)}
        for spec, wide in self._tables:
            wide.write.mode("overwrite").parquet(f"{self.path}/{spec.path}")
            spec.content_sha256 = content_hash(spark.read.parquet(f"{self.path}/{spec.path}"))
            self.manifest.representations.append(spec)
        self.manifest.created_at = datetime.datetime.now(datetime.UTC).isoformat()
        text = json.dumps(asdict(self.manifest), indent=1)
        spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest.json")
        return self.manifest


@dataclass
class Validation:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    raw = json.loads(_text(spark, f"{path}/manifest.json"))
    raw["representations"] = [RepresentationSpec(**r) for r in raw["representations"]]
    return Manifest(**raw)


def check_version(version: str) -> list[str]:
    """Warnings of a newer minor version; BundleError for another major one."""
    major, minor = (int(x) for x in version.split("-")[0].split(".")[:2])
    own_major, own_minor = (int(x) for x in BUNDLE_VERSION.split(".")[:2])
    if major != own_major:
        raise BundleError(f"version {version} can't be read")
    return [f"version {version} is newer than {BUNDLE_VERSION}"] if minor > own_minor else []


def validate_bundle(spark: SparkSession, path: str) -> Validation:
    """Manifest, hashes, counts, ids, order, features and constraints; a table whose hash differs isn't looked into."""
    out = Validation()
    try:
        manifest = read_manifest(spark, path)
        out.warnings += check_version(manifest.schema_version)
    except Exception as e:
        out.errors.append(f"manifest: {str(e).splitlines()[0]}")
        return out
    try:
        objects = spark.read.parquet(f"{path}/{manifest.objects['path']}")
        if content_hash(objects) != manifest.objects["content_sha256"]:
            out.errors.append("objects: the hash differs")
            return out
    except Exception as e:
        out.errors.append(f"objects: {str(e).splitlines()[0]}")
        return out
    if not duplicate_ids(objects).isEmpty():
        out.errors.append("objects: ids repeat")
    for spec in manifest.representations:
        out.errors += [f"{spec.id}: {e}" for e in _faults(spark, path, spec, objects, out.warnings)]
    return out


def _faults(spark: SparkSession, path: str, spec: RepresentationSpec, objects: DataFrame, warnings: list[str]) -> list[str]:
    try:
        table = spark.read.parquet(f"{path}/{spec.path}")
    except Exception as e:
        return [str(e).splitlines()[0]]
    if content_hash(table) != spec.content_sha256:
        return ["the hash differs"]
    if spec.object_id_column not in table.columns:
        return [f"no column {spec.object_id_column}"]
    lacking = [c for c in spec.feature_columns if c not in table.columns]
    if lacking:
        return [f"no columns {', '.join(lacking)}"]
    faults = []
    if len(spec.feature_columns) != spec.dimension:
        faults.append(f"{spec.dimension} dimensions, {len(spec.feature_columns)} columns")
    ids = table.select(F.col(spec.object_id_column).alias("object_id"), "pos")
    if table.count() != objects.count():
        faults.append("the number of rows differs from the objects'")
    if not duplicate_ids(ids).isEmpty():
        faults.append("ids repeat")
    if not missing_ids(ids, objects).isEmpty() or not missing_ids(objects, ids).isEmpty():
        faults.append("ids differ from the objects'")
    elif not out_of_order(ids, objects).isEmpty():
        faults.append("rows stand in another order than the objects")
    broken = constraint_counts(table.withColumn("__v", F.array(*(F.col(c) for c in spec.feature_columns))), "__v", max(PROB_SUM_ATOL, 1e-9)).first()
    return faults + [f"{broken[c]} rows break {c}" for c in spec.constraints if broken[c]]


class BundleReader:
    """A checked bundle's tables."""

    def __init__(self, spark: SparkSession, path: str, check: bool = True) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if check and (found := validate_bundle(spark, self.path)).errors:
            raise BundleError("; ".join(found.errors))
        self.manifest = read_manifest(spark, self.path)

    def objects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/objects.parquet")

    def spec(self, id: str) -> RepresentationSpec:
        for s in self.manifest.representations:
            if s.id == id:
                return s
        raise KeyError(f"no representation {id!r}")

    def table(self, id: str) -> DataFrame:
        """The wide table, features in declared order."""
        s = self.spec(id)
        return self.spark.read.parquet(f"{self.path}/{s.path}").select(s.object_id_column, "pos", *s.feature_columns)

    def points(self, id: str) -> DataFrame:
        """(object_id, pos, vec)."""
        s = self.spec(id)
        return self.table(id).select(F.col(s.object_id_column).alias("object_id"), "pos", F.array(*(F.col(c) for c in s.feature_columns)).alias("vec"))


def discover(spark: SparkSession, directory: str) -> dict[str, str]:
    """Paths of the valid bundles in a folder, by name; what isn't one is left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    inside = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    found = {p.getName(): p.toString() for p in inside if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "manifest.json"))}
    return {name: found[name] for name in sorted(found) if validate_bundle(spark, found[name]).is_valid}
