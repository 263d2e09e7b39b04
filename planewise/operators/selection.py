"""Row-level selections: lookups, rectangles, hit tests, class encodings and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.conventions import PROB_SUM_ATOL
from planewise.functions import vectors
from planewise.operators.neighbors import result


def feature_columns(columns: list[str], id_column: str | None, label_column: str | None) -> list[str]:
    """All columns but ids and labels, in order."""
    return [c for c in columns if c not in {id_column, label_column, "object_id", "id"}]


def lookup(objects: DataFrame, object_id: str) -> DataFrame:
    """The row of an id; ValueError if there is none."""
    found = objects.where(F.col("object_id") == object_id)
    if found.isEmpty():
        raise ValueError(f"unknown object {object_id!r}")
    return found


def marquee(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points in a rectangle, its sides included."""
    return points.where(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))


def selection_summary(selected: DataFrame) -> DataFrame:
    """Count, mean confidence and the predicted classes of a selection of two points at least."""
    out = selected.agg(F.count(F.lit(1)).alias("n"), result(F.avg("confidence")).alias("mean_confidence"), F.array_join(F.array_sort(F.collect_set("predicted_label")), ",").alias("classes"))
    return out.where("n >= 2")


def hit(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The last drawn point within a radius."""
    return points.where(F.hypot(F.col("x") - x, F.col("y") - y) <= radius).orderBy(F.col("pos").desc()).limit(1)


def step(pos: Column, by: int, n: int) -> Column:
    """The place of the next or previous object, around the end."""
    return F.pmod(pos + by, F.lit(n))


def label_codes(points: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): distinct labels in order, from 0; labels are few, so one window numbers them."""
    return points.select(F.col(label).alias("label")).distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)


def duplicate_ids(objects: DataFrame, id_column: str = "object_id") -> DataFrame:
    return objects.groupBy(F.col(id_column).alias("object_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of ``wanted`` that ``known`` lacks."""
    return wanted.select("object_id").distinct().join(known.select("object_id"), "object_id", "left_anti")


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    return missing_ids(a, b).isEmpty() and missing_ids(b, a).isEmpty()


def out_of_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that stand at different places in two tables (object_id, pos)."""
    both = a.select("object_id", F.col("pos").alias("pos_a")).join(b.select("object_id", F.col("pos").alias("pos_b")), "object_id")
    return both.where("pos_a <> pos_b")


def constraint_counts(points: DataFrame, vec: str = "vec", atol: float = PROB_SUM_ATOL) -> DataFrame:
    """Rows that break each declared constraint, in one pass."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    off = lambda to: F.abs(vectors.total(v) - to) > atol
    n = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    return points.agg(F.count(F.lit(1)).alias("n"), n(bad).alias("finite"), n(F.exists(v, lambda x: x < 0)).alias("nonnegative"), n(off(1.0)).alias("row_sum_1"), n(off(0.0)).alias("row_sum_0"))
