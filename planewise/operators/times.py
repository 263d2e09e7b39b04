"""Joins by time: the last row before each row, and points within intervals.

Both stay even if one key holds most rows: the first deals rows by ranges of (key, time),
the second by cells of time within a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from planewise.cutting import cut


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 as a long, without regard to the session's time zone, of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time) if isinstance(time, str) else time)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each left row of a sorted partition the last right row of its key so far; ends with a row on the whole partition.

    ``open`` marks rows before the first right row of the partition's first key: what they
    get stands in an earlier partition.  Memory is one batch and one right row.
    """
    part = first = held_key = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).combine_chunks()
        key, is_right = rows["key"].combine_chunks(), pc.equal(rows["side"], 0).to_numpy()
        part, first = rows["part"][0].as_py(), key[0] if first is None else first
        known = held is not None and key[0].as_py() == held_key.as_py()
        new = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)] if len(key) > 1 else np.array([True])
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        last = np.maximum.accumulate(np.where(is_right, np.arange(len(key)), -1))
        last = np.where(last >= start, last, -1)  # a right row of another key doesn't count
        right = pa.chunked_array([pa.array([held.as_py() if known else None], rows["right"].type), *rows["right"].chunks]).combine_chunks()
        filled = right.take(pa.array(np.where((last < 0) & (start > 0), -1, last + 1), pa.int64(), mask=(last < 0) & (start > 0)))  # place 0 is what came before the batch
        of_first = pc.equal(key, first).to_numpy(zero_copy_only=False)
        out = pa.table({"part": rows["part"], "key": key, "last_key": key, "left": rows["left"], "right": filled, "open": pa.array(of_first & filled.is_null().to_numpy(zero_copy_only=False)), "end": pa.array(np.zeros(len(key), bool))})
        yield from out.filter(pa.array(~is_right)).combine_chunks().to_batches()
        held_key, held = key[-1], filled[-1]
    if first is not None:
        one = lambda v, t: pa.array([v.as_py()], t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), one(first, key.type), one(held_key, key.type), pa.nulls(1, rows["left"].type), one(held, rows["right"].type), pa.array([False]), pa.array([True])],
            names=["part", "key", "last_key", "left", "right", "open", "end"],
        )


def asof(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str | None = None, ties: str | None = None, spread: str | None = None, prefix: str = "right_", parts: int | None = None) -> DataFrame:
    """Each left row once, with the columns of the last right row of its key at or before its time (nulls if none), named with ``prefix``.

    Both tables hold ``key``, of one type, and a time; of right rows of one time that with
    the largest ``ties`` counts (without it, any of them).  Left rows whose key or time is
    null get nulls, right ones match nothing.  Columns may have any name: both rows travel
    as structs.  Sorted ranges of (key, time) are the partitions, so a key may hold all
    rows; ``spread``, a left column, divides left rows of one key and time further.  What a
    partition knows at its end is one row, passed on through a table of one row a partition.
    """
    spark, right_time = left.sparkSession, right_time or time
    if left.schema[key].dataType != right.schema[key].dataType:
        raise ValueError(f"{key} has type {left.schema[key].dataType} on the left and {right.schema[key].dataType} on the right")
    clash = {prefix + c for c in right.columns if c != key} & set(left.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} stand on both sides; give another prefix")
    names = [c for c in right.columns if c != key]
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    lefts = left.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("t"), F.lit(1).alias("side"), F.lit(None).alias("tie"), (F.xxhash64(F.col(f"`{spread}`")) if spread else F.lit(0).cast("long")).alias("salt"), whole(left).alias("left"), F.lit(None).alias("right"))
    rights = right.select(F.col(f"`{key}`").alias("key"), F.col(f"`{right_time}`").alias("t"), F.lit(0).alias("side"), (F.col(f"`{ties}`") if ties else F.lit(None)).alias("tie"), F.lit(0).cast("long").alias("salt"), F.lit(None).alias("left"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("right"))
    known = F.col("key").isNotNull() & F.col("t").isNotNull()
    order = ("key", "t", "side", "tie", "salt")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = lefts.where(known).unionByName(rights.where(known)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = {c: StructType([StructField(f.name, f.dataType) for f in df.schema.fields if f.name in kept]) for c, df, kept in (("left", left, left.columns), ("right", right, names))}
    same = left.schema[key].dataType
    schema = StructType([StructField(c, t) for c, t in (("part", IntegerType()), ("key", same), ("last_key", same), *fields.items(), ("open", BooleanType()), ("end", BooleanType()))])
    filled = cut(ranged.select(F.spark_partition_id().alias("part"), "key", "side", "left", "right").mapInArrow(_fill, schema))
    along = Window.orderBy("part")  # one row a partition
    ends = filled.where("end").withColumn("seen", F.last("right", ignorenulls=True).over(Window.partitionBy("last_key").orderBy("part")))
    before = ends.select("part", F.when(F.lag("last_key").over(along) == F.col("key"), F.lag("seen").over(along)).alias("carried"))
    joined = filled.where("NOT end").join(F.broadcast(before), "part", "left").select("left", F.when(F.col("open"), F.col("carried")).otherwise(F.col("right")).alias("right"))
    missing = lefts.where(~known).select("left", F.lit(None).alias("right"))
    return joined.unionByName(missing).select("left.*", *(F.col(f"right.`{c}`").alias(prefix + c) for c in names))


def within(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, width: int, prefix: str = "point_") -> DataFrame:
    """Every (interval, point) with equal keys and ``start <= time <= end``; the point's columns get ``prefix``.

    ``start``, ``end`` and ``time`` are longs (see ``micros``).  Intervals are classed by
    length in powers of two of ``width``; one of class c touches at most two cells of
    ``width * 2**c``, and a point is sent once to its cell in each class that occurs (64 at
    most), so long intervals cost no more than short ones and each pair meets once.  Null
    keys or bounds, and ends before their starts, match nothing.
    """
    clash = {prefix + c for c in points.columns if c != key} & set(intervals.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} stand on both sides; give another prefix")
    a, b = F.col("a"), F.col("b")
    level = lambda c: (F.lit(width) * F.pow(F.lit(2.0), c)).cast("long")
    cells = intervals.select(F.col(f"`{key}`").alias("k"), F.col(f"`{start}`").cast("long").alias("a"), F.col(f"`{end}`").cast("long").alias("b"), F.struct(*(F.col(f"`{c}`") for c in intervals.columns)).alias("left")).where(a <= b)
    cells = cells.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2((b - a + 1) / F.lit(width)))).cast("int"))
    found = sorted(r[0] for r in cells.select("class").distinct().collect())  # 64 at most
    floor = lambda x: F.expr(f"({x} - pmod({x}, size)) div size")
    cells = cells.withColumn("size", level(F.col("class"))).withColumn("cell", F.explode(F.sequence(floor("a"), floor("b"))))
    rows = points.select(F.col(f"`{key}`").alias("k"), F.col(f"`{time}`").cast("long").alias("at"), F.struct(*(F.col(f"`{c}`") for c in points.columns if c != key)).alias("right")).where(F.col("at").isNotNull())
    rows = rows.withColumn("class", F.explode(F.array(*map(F.lit, found)).cast("array<int>"))).withColumn("size", level(F.col("class"))).withColumn("cell", floor("at"))
    met = cells.join(rows.drop("size"), ["k", "class", "cell"]).where(F.col("at").between(a, b))
    return met.select("left.*", *(F.col(f"right.`{c}`").alias(prefix + c) for c in points.columns if c != key))
