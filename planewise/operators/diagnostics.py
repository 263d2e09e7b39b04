"""How far a plane can be trusted: trustworthiness, continuity, stress, distortion, stability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from planewise.conventions import STABLE_OVERLAP, VOLATILE_OVERLAP
from planewise.functions.metrics import Metric
from planewise.operators import blocks
from planewise.operators.neighbors import both_ranks, ranked, result


def rank_penalty_scale(n: int, k: int) -> float:
    """Venna and Kaski's factor that puts the rank penalty between 0 and 1; 0 where it isn't defined."""
    below = n * k * (2 * n - 3 * k - 1) if k <= n / 2 else n * (n - k) * (n - k - 1)
    return 2.0 / below if below > 0 else 0.0


def _faith(n: int, k: int, penalty: Column) -> Column:
    if n <= k + 1 or k < 1:
        return F.lit(1.0)
    return result(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - rank_penalty_scale(n, k) * F.coalesce(penalty, F.lit(0)))))


def _stress() -> Column:
    hh, ll, hl = F.sum(F.col("h") * F.col("h")), F.sum(F.col("l") * F.col("l")), F.sum(F.col("h") * F.col("l"))
    scaled = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.try_divide(hl * hl, hh * ll)))
    return result(F.when(F.coalesce(hh, F.lit(0.0)) == 0, 0.0).when(ll == 0, 1.0).otherwise(scaled))


def trustworthiness(ranks: DataFrame, n: int, k: int) -> DataFrame:
    return ranks.agg(_faith(n, k, F.sum(F.when((F.col("rl") <= k) & (F.col("rh") > k), F.col("rh") - k))).alias("trustworthiness"))


def continuity(ranks: DataFrame, n: int, k: int) -> DataFrame:
    return ranks.agg(_faith(n, k, F.sum(F.when((F.col("rh") <= k) & (F.col("rl") > k), F.col("rl") - k))).alias("continuity"))


def stress(pairs: DataFrame) -> DataFrame:
    """Kruskal's stress-1 with the best scale, in closed form over one pass; ordered pairs give the same as unordered."""
    return pairs.agg(_stress().alias("stress"))


def summary(pairs: DataFrame, n: int, k: int) -> DataFrame:
    """Trustworthiness, continuity, stress and class counts from one pair frame and one shuffle."""
    ranks = both_ranks(pairs)
    h, l = F.col("rh") <= k, F.col("rl") <= k
    count = lambda c: F.count(F.when(c, 1))
    return ranks.agg(
        _faith(n, k, F.sum(F.when(l & ~h, F.col("rh") - k))).alias("trustworthiness"),
        _faith(n, k, F.sum(F.when(h & ~l, F.col("rl") - k))).alias("continuity"),
        _stress().alias("stress"),
        count(h & l).alias("preserved"), count(h & ~l).alias("torn"), count(l & ~h).alias("false_neighbors"),
    )


def summary_of_blocks(near: DataFrame, n: int, k: int) -> DataFrame:
    """The same from ``blocks.neighbours`` with sums: one small row for each neighbour and each pair of blocks."""
    h, l = F.col("r0") <= k, F.col("r1") <= k
    count = lambda c: F.count(F.when(c, 1))
    hh, ll, hl = (F.sum(c) for c in ("hh", "ll", "hl"))
    scaled = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.try_divide(hl * hl, hh * ll)))
    return near.agg(
        _faith(n, k, F.sum(F.when(l & ~h, F.col("r0") - k))).alias("trustworthiness"),
        _faith(n, k, F.sum(F.when(h & ~l, F.col("r1") - k))).alias("continuity"),
        result(F.when(F.coalesce(hh, F.lit(0.0)) == 0, 0.0).when(ll == 0, 1.0).otherwise(scaled)).alias("stress"),
        count(h & l).alias("preserved"), count(h & ~l).alias("torn"), count(l & ~h).alias("false_neighbors"),
    )


def stability_of_blocks(near: DataFrame, views: int, k: int) -> DataFrame:
    """(object_id, stability) from ``blocks.neighbours`` over several planes."""
    kept = sum((F.when((F.col("r0") <= k) & (F.col(f"r{v}") <= k), 1).otherwise(0) for v in range(1, views + 1)), F.lit(0))
    return near.groupBy("i").agg((F.sum(kept) / F.lit(float(k * views))).alias("stability")).withColumnRenamed("i", "object_id")


def point_distortion(pairs: DataFrame) -> DataFrame:
    """(object_id, distortion): mean ratio of view to source distance, each over its positive mean; near-zero sources are skipped, 1 if all are."""
    means = pairs.agg(F.avg(F.when(F.col("h") > 0, F.col("h"))).alias("mh"), F.avg(F.when(F.col("l") > 0, F.col("l"))).alias("ml")).first()
    mh, ml = means["mh"] or 1.0, means["ml"] or 1.0
    source = F.col("h") / mh
    ratio = F.when(source > 1e-6, (F.col("l") / ml) / source)
    return pairs.groupBy("i").agg(F.coalesce(F.avg(ratio), F.lit(1.0)).alias("distortion")).withColumnRenamed("i", "object_id")


def stress_of_blocks(near: DataFrame) -> DataFrame:
    """Kruskal's stress-1 from the sums of ``blocks.neighbours`` or ``blocks.square_sums``."""
    hh, ll, hl = (F.sum(c) for c in ("hh", "ll", "hl"))
    scaled = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.try_divide(hl * hl, hh * ll)))
    return near.agg(result(F.when(F.coalesce(hh, F.lit(0.0)) == 0, 0.0).when(ll == 0, 1.0).otherwise(scaled)).alias("stress"))


def distortion_of_blocks(placed: DataFrame, dimension: int, metric: Metric) -> DataFrame:
    """(object_id, distortion) of ``blocks.placed`` points with one plane: mean ratio of view to source distance, each over its positive mean; near-zero sources are skipped, 1 if all are.

    One meeting of the blocks gives the means, a second the ratios' sums.
    """
    n = placed.count()
    mh, ml = blocks.mean_distances(placed, dimension, metric, n)
    sums = blocks.ratio_sums(placed, dimension, metric, n, 1e-6 * mh)
    mean = F.try_divide(F.col("ratio") * (mh / ml), F.col("n"))
    return sums.select(F.col("i").alias("object_id"), F.coalesce(mean, F.lit(1.0)).alias("distortion"))


def bounds(points: DataFrame) -> dict[str, float]:
    """The plane's extent padded by 12 % and by 0.05 at least."""
    r: Row = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if r[0] is None:
        return {"xMin": -1.0, "xMax": 1.0, "yMin": -1.0, "yMax": 1.0}
    px, py = max(0.05, 0.12 * (r[1] - r[0])), max(0.05, 0.12 * (r[3] - r[2]))
    return {"xMin": r[0] - px, "xMax": r[1] + px, "yMin": r[2] - py, "yMax": r[3] + py}


def grid(points: DataFrame, box: dict[str, float], resolution: int = 32) -> DataFrame:
    """(row, col, mean_distortion) of filled cells of ``points`` (x, y, distortion); row 0 is the top.

    Cells are closed on all sides: a point on an inner boundary counts in both neighbours.
    """
    n = max(8, min(64, resolution))
    w, h = (box["xMax"] - box["xMin"]) / n, (box["yMax"] - box["yMin"]) / n

    def cells(at: Column) -> Column:
        low = F.floor(at).cast("int")
        on = (at == F.floor(at)) & (low > 0)
        return F.filter(F.when(on, F.array(low - 1, low)).otherwise(F.array(low)), lambda c: (c >= 0) & (c < n))

    placed = points.withColumn("col", F.explode(cells((F.col("x") - box["xMin"]) / w))).withColumn("row", F.explode(cells((box["yMax"] - F.col("y")) / h)))
    return placed.groupBy("row", "col").agg((F.round(F.avg("distortion"), 3) + 0.0).alias("mean_distortion"))


def overlaps(source: DataFrame, views: DataFrame, k: int) -> DataFrame:
    """(object_id, stability): mean share of the k source neighbours that each view keeps.

    ``source`` is (i, j, h); ``views`` is (view_id, i, j, l), ranked within each view.
    """
    near = source.withColumn("rh", ranked("h")).where(F.col("rh") <= k).select("i", "j")
    seen = views.withColumn("rl", ranked("l", ("view_id", "i"))).where(F.col("rl") <= k).select("view_id", "i", "j")
    return _mean_overlap(seen.join(near.withColumn("hit", F.lit(1)), ["i", "j"], "left"), k)


def _mean_overlap(rows: DataFrame, k: int) -> DataFrame:
    per_view = rows.groupBy("i", "view_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("kept"))
    return per_view.groupBy("i").agg(F.avg(F.col("kept") / F.lit(float(k))).alias("stability")).withColumnRenamed("i", "object_id")


def stability_over(wide: DataFrame, views: list[str], k: int) -> DataFrame:
    """The same from one pair frame with a distance column for each view: all windows share one shuffle."""
    ranks = wide.withColumn("rh", ranked("h"))
    for v in views:
        ranks = ranks.withColumn(f"r_{v}", ranked(v))
    kept = sum((F.when((F.col("rh") <= k) & (F.col(f"r_{v}") <= k), 1).otherwise(0) for v in views), F.lit(0))
    return ranks.groupBy("i").agg((F.sum(kept) / F.lit(float(k * len(views)))).alias("stability")).withColumnRenamed("i", "object_id")


def stability_tag(c: Column) -> Column:
    return F.when(c >= STABLE_OVERLAP, "invariant").when(c >= VOLATILE_OVERLAP, "moderate").otherwise("sensitive")


def stability_summary(points: DataFrame) -> DataFrame:
    """Mean stability, share of points that persist and share that are volatile, to four places."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4) + 0.0
    s = F.col("stability")
    return points.agg((F.round(F.avg(s), 4) + 0.0).alias("mean_stability"), share(s >= STABLE_OVERLAP).alias("persistence"), share(s < VOLATILE_OVERLAP).alias("volatile"))


def angle_label(degrees: float) -> str:
    return "tight" if degrees < 15 else "moderate" if degrees < 45 else "divergent"


def is_finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)
