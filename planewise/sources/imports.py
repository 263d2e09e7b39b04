"""Import of vectors from CSV or Parquet: resolve ids and features, validate, derive, write a bundle."""

from __future__ import annotations

import io
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewise.conventions import IMPORT_SUM_ATOL
from planewise.errors import ImportValidationError
from planewise.functions import vectors
from planewise.operators.selection import feature_columns

MAX_UPLOAD_BYTES = 10 * 1024 * 1024
EXTENSIONS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet"}


@dataclass
class Imported:
    """Objects and probabilities of an import, lazily; ``features`` name the vector's entries."""

    objects: DataFrame
    points: DataFrame
    features: list[str]


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file {kind!r}")


def from_bytes(spark: SparkSession, content: bytes, kind: str) -> DataFrame:
    """An upload, which is small (``MAX_UPLOAD_BYTES``), as a DataFrame; nothing is written to disk."""
    from pyarrow import csv, parquet

    try:
        table = csv.read_csv(io.BytesIO(content)) if kind == "csv" else parquet.read_table(io.BytesIO(content))
    except pa.ArrowException as e:
        raise ImportValidationError(f"the file can't be read: {e}") from e
    return spark.createDataFrame(table)


def validate(df: DataFrame, features: list[str], n_classes: int | None = None, softmax: bool = False, sum_atol: float = IMPORT_SUM_ATOL) -> None:
    """ImportValidationError unless rows exist, features are two at least and numeric, entries finite and, without softmax, rows are distributions."""
    if len(features) < 2:
        raise ImportValidationError("two feature columns are needed at least")
    if n_classes is not None and n_classes != len(features):
        raise ImportValidationError(f"{len(features)} feature columns, but {n_classes} classes")
    kinds = dict(df.dtypes)
    odd = [f for f in features if kinds.get(f, "") not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds.get(f, "").startswith("decimal")]
    if odd:
        raise ImportValidationError(f"columns that aren't numbers or aren't there: {', '.join(odd)}")
    v = F.array(*(F.col(f"`{f}`").cast("double") for f in features))
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    negative = F.exists(v, lambda x: x < 0)
    off = F.abs(vectors.total(v) - 1.0) > sum_atol
    n = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    rows, bad, below, unsummed = df.agg(F.count(F.lit(1)), n(infinite), F.count_if(negative), F.count_if(off)).first()
    if not rows:
        raise ImportValidationError("there are no rows")
    if bad:
        raise ImportValidationError(f"{bad} rows hold numbers that aren't finite")
    if not softmax and below:
        raise ImportValidationError(f"{below} rows hold negative probabilities")
    if not softmax and unsummed:
        raise ImportValidationError(f"{unsummed} rows don't sum to 1 within {sum_atol:g}")


def dense_positions(df: DataFrame) -> DataFrame:
    """``df`` with ``pos``, 0 to n - 1 in the order it is read.

    Rows are numbered within their partition and partitions by a prefix sum over their
    counts, one small row each; no task holds more than a partition.
    """
    own = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return own.join(starts, "__part").withColumn("pos", (F.col("__start") + within).cast("long")).drop("__part", "__at", "__start")


def import_frame(df: DataFrame, id_column: str | None = None, label_column: str | None = None, features: list[str] | None = None, n_classes: int | None = None, softmax: bool = False, payload_column: str | None = None) -> Imported:
    """Validate a wide table and derive labels, confidence, entropy (bits) and correctness.

    Without an id column rows are named ``obj_0`` and so on in the order they are read.
    """
    if id_column and id_column not in df.columns:
        raise ImportValidationError(f"no column {id_column!r}")
    id_column = id_column or next((c for c in ("object_id", "id") if c in df.columns), None)
    features = features or [c for c in feature_columns(df.columns, id_column, label_column) if c != payload_column]
    validate(df, features, n_classes, softmax)
    rows = dense_positions(df)
    raw = F.array(*(F.col(f"`{f}`").cast("double") for f in features))
    named = rows.select(
        (F.col(id_column).cast("string") if id_column else F.concat(F.lit("obj_"), F.col("pos"))).alias("object_id"),
        "pos",
        (F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")).alias("true_label"),
        (F.col(payload_column).cast("binary") if payload_column else F.lit(None).cast("binary")).alias("payload_image_bytes"),
        (vectors.softmax(raw) if softmax else vectors.renormalize(raw)).alias("vec"),
    )
    predicted = vectors.argmax_label(F.col("vec"), features)
    objects = named.select(
        "object_id", "pos", F.lit("imported").alias("generator_component"), F.coalesce("true_label", predicted).alias("true_label"), predicted.alias("predicted_label"),
        vectors.correct(F.coalesce("true_label", predicted), predicted).alias("correct"), vectors.confidence(F.col("vec")).alias("confidence"), vectors.entropy(F.col("vec")).alias("entropy"), "payload_image_bytes",
    )
    return Imported(objects, named.select("object_id", "pos", F.coalesce("true_label", predicted).alias("label"), "vec"), features)


def stratified(df: DataFrame, label: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows with each class at its share (one at least), by rank of a seeded hash within the class."""
    total = df.count()
    if total <= rows:
        return df
    order = F.xxhash64(F.lit(seed), *df.columns)
    sizes = df.groupBy(label).agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * rows / total).cast("int")).alias("__most"))
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    return numbered.join(F.broadcast(sizes), label).where("__n <= __most").select(*df.columns)
