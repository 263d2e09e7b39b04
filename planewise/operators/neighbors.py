"""Neighbour graphs, ranks and the classes of neighbours that a view keeps, tears and invents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.conventions import ORDER_PLACES, RESULT_PLACES


def ranked(distance: str = "h", by: tuple[str, ...] = ("i",)) -> Column:
    """Rank of ``j`` among a row's others: by rounded distance, then id."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round(distance, ORDER_PLACES), "j"))


def knn(pairs: DataFrame, k: int, distance: str = "h") -> DataFrame:
    """(src_id, neighbor_id, rank, distance): the k nearest of each object; the limit reaches below the shuffle."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    near = pairs.withColumn("rank", ranked(distance)).where(F.col("rank") <= k)
    return near.select(F.col("i").alias("src_id"), F.col("j").alias("neighbor_id"), "rank", result(F.col(distance)).alias("distance"))


def knn_of(pairs: DataFrame, k: int, distance: str = "h") -> DataFrame:
    """The same for pairs of one target: a top-k without a window."""
    top = pairs.orderBy(F.round(distance, ORDER_PLACES), "j").limit(k)
    return top.select(F.col("i").alias("src_id"), F.col("j").alias("neighbor_id"), result(F.col(distance)).alias("distance"))


def both_ranks(pairs: DataFrame, by: tuple[str, ...] = ("i",)) -> DataFrame:
    """Source rank ``rh`` and view rank ``rl`` of each pair, over one shuffle."""
    return pairs.withColumn("rh", ranked("h", by)).withColumn("rl", ranked("l", by))


def block_ranks(near: DataFrame) -> DataFrame:
    """(i, j, rh, rl) of the pairs that ``blocks.neighbours`` gives for one plane."""
    return near.where(F.col("i").isNotNull()).select("i", "j", F.col("r0").cast("int").alias("rh"), F.col("r1").cast("int").alias("rl"))


def block_knn(near: DataFrame, k: int) -> DataFrame:
    """The k nearest by the metric of each object, as ``knn`` gives them."""
    return near.where(F.col("r0") <= k).select(F.col("i").alias("src_id"), F.col("j").alias("neighbor_id"), F.col("r0").cast("int").alias("rank"), result(F.col("d0")).alias("distance"))


def classes(ranks: DataFrame, k: int) -> DataFrame:
    """(src_id, neighbor_id, class, source_rank, view_rank) of pairs that are neighbours on either side."""
    near = ranks.where((F.col("rh") <= k) | (F.col("rl") <= k))
    kind = F.when((F.col("rh") <= k) & (F.col("rl") <= k), "preserved").when(F.col("rh") <= k, "torn").otherwise("false")
    return near.select(F.col("i").alias("src_id"), F.col("j").alias("neighbor_id"), kind.alias("class"), F.col("rh").alias("source_rank"), F.col("rl").alias("view_rank"))


def precision_recall(classified: DataFrame) -> DataFrame:
    """Counts, precision, recall and Jaccard of each object; 1 where there is nothing to count."""
    n = lambda c: F.count(F.when(F.col("class") == c, 1))
    counts = classified.groupBy("src_id").agg(n("preserved").alias("preserved"), n("torn").alias("torn"), n("false").alias("false_neighbors"))
    p, t, f = (F.col(c) for c in ("preserved", "torn", "false_neighbors"))
    share = lambda a, b: result(F.coalesce(F.try_divide(a, b), F.lit(1.0)))
    return counts.select("*", share(p, p + f).alias("precision"), share(p, p + t).alias("recall"), share(p, p + t + f).alias("jaccard"))


def topology(classified: DataFrame) -> DataFrame:
    """Edges to draw, each unordered pair once a type, from the object that comes first (by id) and its nearer neighbour."""
    kind = F.col("class")
    rank = F.when(kind == "false", F.col("view_rank")).otherwise(F.col("source_rank"))
    key = [F.least("src_id", "neighbor_id").alias("__a"), F.greatest("src_id", "neighbor_id").alias("__b")]
    first = Window.partitionBy("__a", "__b", "class").orderBy("src_id", "__rank", "neighbor_id")
    seen = classified.select("*", rank.alias("__rank"), *key).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return seen.select(F.col("src_id").alias("source"), F.col("neighbor_id").alias("target"), kind.alias("type"))


def drawn(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(source, target, type, x1, y1, x2, y2): edges with the plane coordinates (object_id, x, y) of both ends."""
    end = lambda name, n: placed.select(F.col("object_id").alias(name), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return edges.join(end("source", 1), "source").join(end("target", 2), "target").select("source", "target", "type", "x1", "y1", "x2", "y2")


def result(c: Column, places: int = RESULT_PLACES) -> Column:
    """A number as it leaves a query; never a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def result_of_pair(c: Column, places: int = RESULT_PLACES) -> Column:
    """The same as ``result`` for columns with a row for each pair: decimals, which rounding takes, only near a half."""
    scaled = c * F.lit(10.0**places)
    clear = (F.abs(c) < 1e6) & (F.abs(scaled - F.rint(scaled)) < 0.49)
    return F.when(clear, F.rint(scaled) / F.lit(10.0**places)).otherwise(F.round(c, places)) + F.lit(0.0)
