"""The registry of datasets and a baseline classifier that turns labelled features into beliefs."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.errors import ImportValidationError
from planewise.functions import vectors
from planewise.sources import imports
from planewise.sources.tables import embeddings


@dataclass(frozen=True)
class DatasetSpec:
    """A dataset that can be made from the driver's tables or generated."""

    key: str
    title: str
    n_classes: int
    source: str


REGISTRY = {
    s.key: s
    for s in (
        DatasetSpec("calibration", "Fixed points of the simplex", 3, "generated"),
        DatasetSpec("synthetic", "Four-class belief world", 4, "generated"),
        DatasetSpec("apparel", "Ten-class apparel beliefs", 10, "generated"),
        DatasetSpec("embeddings", "Baseline beliefs about embedding labels", 10, "embeddings"),
        DatasetSpec("iris_3class", "Iris flowers", 3, "table"),
        DatasetSpec("wine_3class", "Wines of three growers", 3, "table"),
        DatasetSpec("digits_10class", "Handwritten digits of 8 x 8 pixels", 10, "table"),
        DatasetSpec("covertype_7class", "Forest cover types", 7, "table"),
    )
}
#: Rows of a benchmark table that are taken, stratified by class.
FETCHED_ROWS = 5000


def fetch(spark: SparkSession, key: str, path: str, label: str = "target", rows: int = FETCHED_ROWS, seed: int = 42) -> tuple[DataFrame, list[str], DataFrame]:
    """(points, class names, objects) of a benchmark dataset from a CSV or Parquet copy of its table: numeric features and a label.

    Tables aren't downloaded.  Beliefs are the baseline classifier's.  Pixels of digits
    (0 to 16) become each object's payload, a grey image with a plain header (PGM).
    """
    spec = REGISTRY[key]
    if spec.source != "table":
        raise ValueError(f"{key} isn't read from a table")
    table = imports.read(spark, path, imports.EXTENSIONS[os.path.splitext(path)[1].lower()])
    if label not in table.columns:
        raise ImportValidationError(f"no column {label!r}")
    numbered = imports.dense_positions(imports.stratified(table, label, rows, seed))
    features = [c for c, kind in table.dtypes if c != label and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    prefix = "digit_" if key.startswith("digits") else ""
    vec = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    read = numbered.select(F.format_string(f"{key}_%05d", "pos").alias("object_id"), "pos", F.concat(F.lit(prefix), F.col(f"`{label}`").cast("string")).alias("label"), vec.alias("features"))
    beliefs, classes = fit_baseline(read, vec="features")
    if len(classes) != spec.n_classes:
        raise ImportValidationError(f"{key} has {spec.n_classes} classes, the table {len(classes)}")
    points = beliefs.join(read.select("object_id", "pos"), "object_id").select("object_id", "pos", "label", "vec")
    predicted = vectors.argmax_label(F.col("vec"), classes)
    objects = points.select("object_id", "pos", F.lit("fetched").alias("generator_component"), F.col("label").alias("true_label"), predicted.alias("predicted_label"), vectors.correct(F.col("label"), predicted).alias("correct"), vectors.confidence(F.col("vec")).alias("confidence"), vectors.entropy(F.col("vec")).alias("entropy"))
    if key.startswith("digits"):
        pixel = lambda x: F.lpad(F.hex(F.least(F.floor(x * 255 / 16), F.lit(255)).cast("long")), 2, "0")
        side = round(len(features) ** 0.5)
        image = F.concat(F.lit(f"P5 {side} {side} 255\n".encode().hex()), F.array_join(F.transform("features", pixel), ""))
        objects = objects.join(read.select("object_id", F.unhex(image).alias("payload_image_bytes")), "object_id")
    return points, classes, objects


def fit_baseline(points: DataFrame, label: str = "label", vec: str = "vec", iterations: int = 100) -> tuple[DataFrame, list[str]]:
    """(object_id, label, vec of class probabilities) by multinomial logistic regression on standardised features, and the classes in order.

    The penalty is 1/N, as of a unit prior on weights.  Features are scaled by the
    population deviation.  Probabilities are taken as they come; a second softmax would
    flatten them.
    """
    n = points.count()
    # Few by contract: they are the axes of the result.
    classes = [r[0] for r in points.select(label).distinct().orderBy(label).collect()]
    code = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i)))), F.col(label))
    # The scaler divides by the sample deviation; the factor turns it into the population's.
    read = points.select("object_id", F.col(label).alias("label"), array_to_vector(F.col(vec)).alias("__raw"), code.alias("__code"))
    scaled = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(read).transform(read)
    factor = (n / max(n - 1, 1)) ** 0.5
    scaled = scaled.withColumn("__scaled", array_to_vector(F.transform(vector_to_array("__scaled"), lambda x: x * factor)))
    model = LogisticRegression(featuresCol="__scaled", labelCol="__code", family="multinomial", regParam=1.0 / max(n, 1), standardization=False, maxIter=iterations).fit(scaled)
    return model.transform(scaled).select("object_id", "label", vector_to_array("probability").alias("vec")), [str(c) for c in classes]


def embedding_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline beliefs about the labels of the driver's embeddings."""
    return fit_baseline(embeddings(spark, sf_dir))[0]


def point_metadata(points: DataFrame, names: list[str]) -> DataFrame:
    """Each point's predicted class, confidence, entropy and whether it is right, with names freed of ``p_``."""
    predicted = vectors.argmax_label(F.col("vec"), names)
    return points.select("object_id", F.regexp_replace("label", "^p_", "").alias("label"), predicted.alias("predicted_label"), vectors.confidence(F.col("vec")).alias("confidence"), vectors.entropy(F.col("vec")).alias("entropy"), vectors.correct(F.regexp_replace("label", "^p_", ""), predicted).alias("correct"))


def neighbours_in_order(points: DataFrame, object_id: str) -> tuple[str, str]:
    """The ids before and after an object in the order of ``pos``, around the ends."""
    own = points.where(F.col("object_id") == object_id).select("pos").first()
    if own is None:
        raise ValueError(f"unknown object {object_id!r}")
    below, above = (F.when(c, F.col("pos")) for c in (F.col("pos") < own[0], F.col("pos") > own[0]))
    # One pass with partial aggregates; extremes of a null order are left out.
    r = points.agg(F.max_by("object_id", below), F.min_by("object_id", above), F.max_by("object_id", "pos"), F.min_by("object_id", "pos")).first()
    return r[0] or r[2], r[1] or r[3]
