"""The driver's tables as engine views, each (object_id, vec, ...) with the same view as DuckDB SQL beside it.

Ids are padded with zeros, so that their order as strings is their order as numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import vectors

# The categories that make the axes of a composition, in order.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@dataclass(frozen=True)
class View:
    """A named view: its dimension and its SQL as common table expressions ending in ``v(object_id, vec, ...)``."""

    name: str
    dimension: int
    sql: str


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), width, "0"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of 64 entries with a class of ten."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select(_id("vec_", "vec_id", 6).alias("object_id"), F.col("embedding").cast("array<double>").alias("vec"), F.concat(F.lit("class_"), F.col("label")).alias("label"))


EMBEDDINGS = View("embeddings", 64, "v AS (SELECT 'vec_' || lpad(vec_id::VARCHAR, 6, '0') AS object_id, embedding::DOUBLE[] AS vec, 'class_' || label AS label FROM embeddings)")


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of the first ten entries, sharpened: ten-class probabilities without zeros."""
    v = embeddings(spark, sf_dir)
    return v.select("object_id", vectors.softmax(F.transform(F.slice("vec", 1, 10), lambda x: x * 8.0)).alias("vec"), "label")


BELIEFS = View("beliefs", 10, """e AS (SELECT 'vec_' || lpad(vec_id::VARCHAR, 6, '0') AS object_id, 'class_' || label AS label, list_transform(embedding[1:10]::DOUBLE[], lambda x: exp(8 * x)) AS e FROM embeddings),
v AS (SELECT object_id, list_transform(e, lambda x: x / list_sum(e)) AS vec, label FROM e)""")


def _shares(df: DataFrame, key: str, kind: str, kinds: tuple[str, ...], prefix: str, width: int) -> DataFrame:
    counts = df.groupBy(key).agg(*(F.count(F.when(F.col(kind) == k, 1)).cast("double").alias(f"n{i}") for i, k in enumerate(kinds)))
    whole = sum((F.col(f"n{i}") for i in range(1, len(kinds))), F.col("n0"))
    return counts.where(whole > 0).select(_id(prefix, key, width).alias("object_id"), F.array(*(F.col(f"n{i}") / whole for i in range(len(kinds)))).alias("vec"))


def _shares_sql(table: str, key: str, kind: str, kinds: tuple[str, ...], prefix: str, width: int) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {kind} = '{k}')" for k in kinds)
    return f"""e AS (SELECT '{prefix}' || lpad({key}::VARCHAR, {width}, '0') AS object_id, [{counts}]::DOUBLE[] AS e FROM {table} GROUP BY {key}),
v AS (SELECT object_id, list_transform(e, lambda x: x / list_sum(e)) AS vec FROM e WHERE list_sum(e) > 0)"""


def mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's shares of order priorities: many exact zeros and ties."""
    return _shares(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", PRIORITIES, "cust_", 8)


MIXES = View("mixes", 5, _shares_sql("orders", "o_custkey", "o_orderpriority", PRIORITIES, "cust_", 8))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's shares of event types."""
    return _shares(_read(spark, sf_dir, "events"), "user_id", "event_type", EVENT_TYPES, "user_", 8)


ACTIVITIES = View("activities", 5, _shares_sql("events", "user_id", "event_type", EVENT_TYPES, "user_", 8))
