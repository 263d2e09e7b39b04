"""Nearest neighbours by a metric index: exact with the triangle inequality, or approximate with a few probes.

Some hundred points of the table are pivots; every other point belongs to the cell of the
nearest one.  A cell knows the least and the largest distance to its pivot, so a search
can tell cells that hold nothing nearer than what it has already: by the triangle
inequality, which all metrics here obey, and because a cell's points are nearer to its
pivot than to any other.  The exact search first takes bounds from the point's own cell,
then visits the cells that are left.  The approximate search visits the cells of the
nearest pivots only (Voronoi hashing with several probes); what it finds has exact
distances.

Points with equal vectors are one entry that names the first k + 1 ids, all that can be
neighbours of anything, so any number of copies costs no more than one of them.  Cells
with many points are searched in parts, and many visitors of a cell come in parts too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.conventions import ORDER_PLACES
from planewise.cutting import cut
from planewise.functions.metrics import Metric
from planewise.operators.neighbors import result
from planewise.shipping import ship

#: Pivots at most (the driver holds them), entries of a cell and visitors of it that one task takes.
MOST_PIVOTS, PART_ROWS, VISIT_ROWS = 2_048, 20_000, 20_000
#: Visitors whose distances are held at once.
HELD_ROWS = 256
#: Distances are compared with this much to spare for their last bits.
SLACK = 1e-7


class _Index:
    """Pivots with the reach of their cells, and the search within a cell's part."""

    def __init__(self, metric: Metric, dimension: int, k: int, pivots: np.ndarray) -> None:
        self.block, self.entries, self.k, self.pivots = metric.block, [f"s{d}" for d in range(dimension)], k, pivots
        self.near = self.far = np.zeros(len(pivots))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.block([x[:, None] for x in a.T], [x[None, :] for x in b.T])

    def vectors(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[self.entries].to_numpy(np.float64)

    def assigned(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each entry with its cell and the distance to its pivot."""
        for rows in frames:
            for i in range(0, len(rows), HELD_ROWS):
                part = rows.iloc[i : i + HELD_ROWS]
                d = self.between(self.vectors(part), self.pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), reach=d[np.arange(len(part)), cell])

    def visits(self, part: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
        """A row for each cell that may hold something within ``bound`` of an entry."""
        d = self.between(self.vectors(part), self.pivots)
        least = np.maximum(np.maximum(d - self.far, self.near - d), (d - d.min(axis=1)[:, None]) / 2)
        at, cell = np.nonzero((least <= bound[:, None] + SLACK) & np.isfinite(self.far))
        return part[["gid", *self.entries]].iloc[at].assign(cell=cell.astype(np.int32))

    def bounded(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Visits of a part's entries: the k + 1 nearest ids of the part and of the pivots bound those of the table."""
        out = [pd.DataFrame({"gid": pd.Series(dtype=str), **{c: pd.Series(dtype=float) for c in self.entries}, "cell": pd.Series(dtype=np.int32)})]
        everyone, ids = self.vectors(rows), rows["ids"].map(len).to_numpy()
        asked = np.flatnonzero(rows["asked"].to_numpy(bool))
        for i in range(0, len(asked), HELD_ROWS):
            part = rows.iloc[asked[i : i + HELD_ROWS]]
            bound = np.full(len(part), np.inf)
            own = self.between(self.vectors(part), everyone)
            if ids.sum() > self.k:
                n = min(self.k + 1, len(ids))
                near = np.argpartition(own, n - 1, axis=1)[:, :n]
                d = np.take_along_axis(own, near, axis=1)
                order = np.argsort(d, axis=1)
                held = np.cumsum(ids[np.take_along_axis(near, order, axis=1)], axis=1) > self.k
                bound = np.where(held.any(axis=1), np.take_along_axis(np.sort(d, axis=1), held.argmax(axis=1)[:, None], axis=1)[:, 0], np.inf)
            if len(self.pivots) > self.k:
                bound = np.minimum(bound, np.partition(self.between(self.vectors(part), self.pivots), self.k, axis=1)[:, self.k])
            out.append(self.visits(part, bound))
        return pd.concat(out)

    def probed(self, probes: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Visits of the cells of the nearest pivots."""
        for rows in frames:
            for i in range(0, len(rows), HELD_ROWS):
                part = rows.iloc[i : i + HELD_ROWS]
                cells = np.argsort(self.between(self.vectors(part), self.pivots), axis=1)[:, :probes]
                at = np.repeat(np.arange(len(part)), cells.shape[1])
                yield part[["gid", *self.entries]].iloc[at].assign(cell=cells.ravel().astype(np.int32))

    def found(self, visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """(gid, j, d): the k + 1 nearest ids of a part for each visitor."""
        out: tuple[list[str], list[str], list[float]] = ([], [], [])
        if len(visitors) and len(rows):
            rows = rows.sort_values("gid")  # places order equal distances as first ids do
            ids, everyone = list(rows["ids"]), self.vectors(rows)
            n = min(self.k + 1, len(rows))
            for i in range(0, len(visitors), HELD_ROWS):
                part = visitors.iloc[i : i + HELD_ROWS]
                d = self.between(self.vectors(part), everyone)
                # Distance to the places that count and then the entry's place, as one number without ties.
                key = np.rint(d * 10.0**ORDER_PLACES).astype(np.int64) * len(rows) + np.arange(len(rows))
                near = np.argpartition(key, n - 1, axis=1)[:, :n]
                for gid, at, own, keys in zip(part["gid"], near, np.take_along_axis(d, near, axis=1), np.take_along_axis(key, near, axis=1) // len(rows), strict=True):
                    best = sorted((r, j, x) for r, x, p in zip(keys.tolist(), own.tolist(), at.tolist(), strict=True) for j in ids[p])[: self.k + 1]
                    out[0].extend([gid] * len(best))
                    out[1].extend(j for _, j, _ in best)
                    out[2].extend(x for _, _, x in best)
        return pd.DataFrame(dict(zip(("gid", "j", "d"), out, strict=True)))


def _entries(points: DataFrame, dimension: int, k: int) -> DataFrame:
    """(gid, ids, s0..): each distinct vector with its first k + 1 ids; the limit reaches below the shuffle."""
    vec = [f"s{d}" for d in range(dimension)]
    first = F.row_number().over(Window.partitionBy(*vec).orderBy("object_id"))
    few = points.withColumn("nth", first).where(F.col("nth") <= k + 1)
    return few.groupBy(*vec).agg(F.array_sort(F.collect_list("object_id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "ids", *vec)


def neighbours(points: DataFrame, dimension: int, metric: Metric, k: int, probes: int | None = None, asked: Column | None = None, pivots: int | None = None) -> DataFrame:
    """(src_id, neighbor_id, rank, distance): the k nearest of each of the ``blocks.placed`` points.

    Exact, or with ``probes`` from the cells of so many nearest pivots.  ``asked``, a
    condition on ``object_id``, restricts the points that are searched for, not those
    that are found.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    if metric.block is None or not metric.is_metric:
        raise ValueError(f"{metric.id} is no metric with a form for blocks")
    spark = points.sparkSession
    ship(spark)
    vec = [f"s{d}" for d in range(dimension)]
    columns = ", ".join(f"{c} double" for c in vec)
    points = points.select("object_id", *vec)
    if asked is not None:
        points = points.withColumn("asked", asked)
    entries = cut(_entries(points, dimension, k))
    n = entries.count()
    count = min(MOST_PIVOTS, pivots or max(k + 2, round(math.sqrt(n))))
    # The pivots are a sample by a hash of the id; every point is in the index.
    held = entries.orderBy(F.xxhash64("gid"), "gid").limit(count).select(*vec).toPandas().to_numpy(np.float64)
    none = spark.createDataFrame([], "src_id string, neighbor_id string, rank int, distance double")
    if not len(held):
        return none
    index = _Index(metric, dimension, k, held)
    cores = spark.sparkContext.defaultParallelism
    wanted = entries.withColumn("asked", F.lit(True)) if asked is None else entries.join(points.where("asked").select(*vec).distinct().withColumn("asked", F.lit(True)), vec, "left").fillna(False, ["asked"])
    placed = cut(wanted.repartition(max(2 * cores, -(-n // PART_ROWS)), "gid").mapInPandas(index.assigned, f"gid string, ids array<string>, {columns}, asked boolean, cell int, reach double"))
    # One row a cell: at most MOST_PIVOTS.
    reach = placed.groupBy("cell").agg(F.min("reach").alias("near"), F.max("reach").alias("far"), F.count(F.lit(1)).alias("n")).toPandas().set_index("cell").reindex(range(len(held)))
    index.near, index.far = reach["near"].fillna(np.inf).to_numpy(), reach["far"].fillna(np.nan).to_numpy()
    index.far = np.where(np.isnan(index.far), -np.inf, index.far)  # an empty cell is never visited
    sizes = spark.createDataFrame([(int(c), max(1, -(-int(m) // PART_ROWS))) for c, m in reach["n"].dropna().items()], "cell int, parts int")
    own = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    if probes is None:
        rows = own.repartition(max(2 * cores, -(-n // PART_ROWS)), "cell", "part").groupBy("cell", "part")
        visits = cut(rows.applyInPandas(lambda part: index.bounded(part), f"gid string, {columns}, cell int"))
    else:
        visits = cut(placed.where("asked").select("gid", *vec).mapInPandas(lambda frames: index.probed(probes, frames), f"gid string, {columns}, cell int"))
    guests = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).cast("int").alias("groups")).join(F.broadcast(sizes), "cell")
    few = [tuple(r) for r in guests.select("cell", "groups", "parts").collect()]  # one row a cell
    table = lambda: spark.createDataFrame(few, "cell int, groups int, parts int")
    met = sum(groups * parts for _, groups, parts in few)
    dealt = lambda df: df.repartition(max(2 * cores, min(met, 10_000)), "cell", "part", "guest").groupBy("cell", "part", "guest")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    visitors = visits.join(F.broadcast(table()), "cell").withColumn("guest", F.pmod(F.xxhash64("gid"), F.col("groups")).cast("int")).withColumn("part", numbers("parts"))
    hosts = own.drop("parts").join(F.broadcast(table().drop("parts")), "cell").withColumn("guest", numbers("groups"))
    found = dealt(visitors).cogroup(dealt(hosts)).applyInPandas(lambda a, b: index.found(a, b), "gid string, j string, d double")
    order = Window.partitionBy("gid").orderBy(F.round("d", ORDER_PLACES), "j")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = best.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("nth", "j", "d"))).alias("best"))
    members = points if asked is None else points.where("asked")
    named = members.select("object_id", *vec).join(entries.select("gid", *vec), vec).select("object_id", "gid").join(lists, "gid")
    others = F.slice(F.filter("best", lambda x: x["j"] != F.col("object_id")), 1, k)
    opened = named.select(F.col("object_id").alias("src_id"), F.posexplode(others).alias("at", "x"))
    return opened.select("src_id", F.col("x.j").alias("neighbor_id"), (F.col("at") + 1).cast("int").alias("rank"), result(F.col("x.d")).alias("distance"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_neighbors, recall): the share of exact neighbours (src_id, neighbor_id) that were found, of the points in ``exact``."""
    hit = found.select("src_id", "neighbor_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["src_id", "neighbor_id"], "left").agg(F.count(F.lit(1)).alias("n_neighbors"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
