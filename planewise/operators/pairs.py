"""Pair frames: every object against every other, once, as scalar expressions.

The smaller side is broadcast while it has at most ``BROADCAST_ROWS`` rows, which is
counted.  Beyond that both sides are cut into blocks that meet by an equi-join on the
block numbers, so no task holds a whole side and the work spreads over all blocks.
Unordered pairs of one set come from half of the blocks' meetings: blocks are ranges of
ids, so a block's ids come before those of all later ones, and written pairs hold long
runs of one id.

Where rows repeat, as shares of counts do, equal ones meet as one row with their ids and
are dealt out afterwards: fewer rows are sent, a distance is taken once for all pairs of
two such rows, and written pairs hold runs of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.cutting import cut
from planewise.functions.metrics import Metric

BROADCAST_ROWS = 20_000
#: Rows of a block; a join keeps up to 4,096 rows of a key as plain rows.
BLOCK_ROWS = 3_500
#: Meetings of blocks for each core at least (they fall to tasks by hash), and sampled ids for each bound of a range.
MEETINGS, SAMPLED = 16, 200
MOST_PARTITIONS = 10_000
#: Ids of equal rows that stand as one at most, ids for each such row from which on they do, and ids of a block of them.
COPIES, COPIED_FROM, BLOCK_IDS = 256, 4, 56_000


@dataclass
class Space:
    """Objects with prepared scalar coordinates ``s0..``, their terms ``t0..``, if the metric has them, and, if viewed, plane coordinates ``x`` and ``y``."""

    frame: DataFrame
    dimension: int
    metric: Metric
    viewed: bool = False
    extra: list[str] = field(default_factory=list)


def space(points: DataFrame, vec: str, dimension: int, metric: Metric, plane: tuple[Column, Column] | None = None, extra: list[str] | None = None) -> Space:
    """Prepare ``points`` (object_id, vector) for pairing; null vectors are left out."""
    extra = extra or []
    read = points.where(F.col(vec).isNotNull())
    if plane:
        read = read.withColumn("__x", plane[0]).withColumn("__y", plane[1])
    read = read.withColumn("__p", metric.prepare(F.col(vec)))
    columns = [F.col("__p")[k].alias(f"s{k}") for k in range(dimension)]
    if metric.term:
        columns += [metric.term(F.col("__p")[k]).alias(f"t{k}") for k in range(dimension)]
    view = [F.col("__x").alias("x"), F.col("__y").alias("y")] if plane else []
    return Space(read.select("object_id", *extra, *columns, *view), dimension, metric, bool(plane), extra)


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def meet(left: DataFrame, right: DataFrame, condition: Column | None = None, once: bool = False) -> DataFrame:
    """All combinations of two sides' rows, by broadcast of a counted side or block by block.

    ``once`` is for sides of the same rows whose first column is their id: of two blocks,
    the one of lower ids is on the left, and ``condition`` is left to the rows of one block.

    The number of partitions is given: sides are few bytes for the pairs they make, and
    adaptive execution, which goes by bytes, would put all blocks into a few tasks.
    """
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    few = right.limit(BROADCAST_ROWS + 1).count()
    if few <= BROADCAST_ROWS:
        both = left.repartition(2 * cores).crossJoin(F.broadcast(right))
        return both if condition is None else both.where(condition)
    n = right.count()
    nr = math.ceil(n / BLOCK_ROWS)
    if once:
        nl = nr = min(n, max(nr, math.ceil(math.sqrt(2 * MEETINGS * cores))))
        bounds = F.array(*map(F.lit, _bounds(right, nr)))
        number = lambda df: F.size(F.filter(bounds, lambda x: x <= F.col(df.columns[0])))
        a, b = left.withColumn("__l", number(left)), right.withColumn("__r", number(right))
    else:
        n = left.count()
        nl = max(1, math.ceil(n / BLOCK_ROWS), min(n, math.ceil(MEETINGS * cores / nr)))
        a, b = (df.withColumn(c, F.pmod(F.xxhash64(df.columns[0]), F.lit(m)).cast("int")) for df, c, m in ((left, "__l", nl), (right, "__r", nr)))
    a = a.withColumn("__r", F.explode(F.sequence(F.col("__l") if once else F.lit(0), F.lit(nr - 1))))
    b = b.withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("__r") if once else F.lit(nl - 1))))
    met = nr * (nr + 1) // 2 if once else nl * nr
    both = _dealt(a, b, min(max(2 * met, 2 * cores), MOST_PARTITIONS))
    if condition is not None:
        both = both.where((F.col("__l") != F.col("__r")) | condition if once else condition)
    return both.drop("__l", "__r")


def _dealt(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The two sides' rows of equal block numbers, in so many partitions."""
    return a.repartition(n, "__l", "__r").join(b.repartition(n, "__l", "__r").hint("merge"), ["__l", "__r"])


def _as_one(frame: DataFrame) -> tuple[DataFrame, int, int] | None:
    """(ids, the other columns) of rows that are equal but for their id, ``COPIES`` ids a row about, and the numbers of rows and of ids; None if few are equal.

    Ids are dealt by hash among as many rows as they need, so no task holds all copies.
    """
    key = [c for c in frame.columns if c != "object_id"]
    hashed = frame.withColumn("__h", F.xxhash64(*key))
    counts = hashed.groupBy("__h").count()
    different, n = counts.agg(F.count("*"), F.sum("count")).first()
    if n is None or n < COPIED_FROM * different:
        return None
    more = counts.where(F.col("count") > COPIES).select("__h", F.ceil(F.col("count") / COPIES).alias("__n"))
    parted = hashed.join(F.broadcast(more), "__h", "left").withColumn("__n", F.pmod(F.xxhash64("object_id"), F.coalesce("__n", F.lit(1))))
    # A structure keeps an id that is null.
    held = cut(parted.groupBy(*key, "__n").agg(F.sort_array(F.collect_list(F.struct("object_id"))).alias("ids")).select(F.col("ids")["object_id"].alias("ids"), *key))
    return held, held.count(), n


def _meet_as_one(left: DataFrame, right: DataFrame) -> tuple[DataFrame, int] | None:
    """All combinations of two sides' rows, equal rows as one, with the prefixes ``a_`` and ``b_``, and their number of partitions; None if few are equal or few are on the right."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return None
    second = _as_one(right)
    first = second if left is right else second and _as_one(left)
    if not first or not second:
        return None
    (a, ra, na), (b, rb, nb) = first, second
    meetings = MEETINGS * left.sparkSession.sparkContext.defaultParallelism
    few = lambda rows, ids, least: min(rows, max(math.ceil(rows / BLOCK_ROWS), math.ceil(ids / BLOCK_IDS), least))
    nr = few(rb, nb, 1)
    nl = few(ra, na, math.ceil(meetings / nr))
    numbered = lambda df, n, own, other, others: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    n = min(2 * nl * nr, MOST_PARTITIONS)
    return _dealt(numbered(_side(a, "a_"), nl, "__l", "__r", nr), numbered(_side(b, "b_"), nr, "__r", "__l", nl), n).drop("__l", "__r"), n


def _bounds(rows: DataFrame, n: int) -> list:
    """First ids of all but the first of ``n`` ranges of about equally many ids, from a sample by hash."""
    ids = rows.select(F.col(rows.columns[0]).alias("id")).distinct()
    held = sorted(r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * n).collect())
    return [held[k * len(held) // n] for k in range(1, n)]


def pairs(s: Space, target: str | None = None, unordered: bool = False, other: Space | None = None, carry: list[str] | None = None) -> DataFrame:
    """(i, j, h[, l]) of all ordered pairs of different objects; ``h`` is the metric, ``l`` the distance in the plane.

    ``target`` restricts ``i`` before anything is paired.  ``unordered`` keeps i < j.
    ``other`` pairs two sets, equal ids included.
    """
    carry = carry or []
    left = s.frame if target is None else s.frame.where(F.col("object_id") == target)
    right = (other or s).frame
    condition = None if other else (F.col("a_object_id") < F.col("b_object_id") if unordered else F.col("a_object_id") != F.col("b_object_id"))
    once = unordered and not other and target is None and not carry
    if once:
        left = right = left.where(F.col("object_id").isNotNull())
    ones = _meet_as_one(left, right) if target is None and not carry else None
    both = ones[0] if ones else meet(_side(left, "a_"), _side(right, "b_"), condition, once)
    of = lambda p: [F.col(f"{p}{c}{k}") for c in ("st" if s.metric.term else "s") for k in range(s.dimension)]
    ends = ["a_ids", "b_ids"] if ones else ["a_object_id", "b_object_id"]
    out = [F.col(ends[0]).alias("i"), F.col(ends[1]).alias("j"), s.metric.combine(of("a_"), of("b_")).alias("h")]
    if s.viewed and not other:
        out.append(F.sqrt((F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")) + (F.col("a_y") - F.col("b_y")) * (F.col("a_y") - F.col("b_y"))).alias("l"))
    met = both.select(*out, *(F.col(f"a_{c}").alias(c) for c in carry))
    if not ones:
        return met
    # The join gives all rows that meet a left one at once; this leaves their number as it is and keeps that from the rows dealt out of them.
    met = met.coalesce(ones[1])
    for end in "ij":
        met = met.select(*(F.explode(c).alias(c) if c == end else F.col(c) for c in met.columns))
    return met if other else met.where(F.col("i") < F.col("j") if unordered else F.col("i") != F.col("j"))
