"""Joins by time against plain loops: ties, nulls, hot keys, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from planewise.operators import times


def plain_asof(left, right):
    out = []
    for i, k, t in left:
        fits = [(rt, tie, v) for k2, rt, tie, v in right if k is not None and k == k2 and None not in (t, rt) and rt <= t]
        out.append((i, max(fits)[2] if fits else None))
    return sorted(out)


def drawn(n, keys, seed):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.05 else (0 if r.random() < 0.6 else r.randrange(keys))
    at = lambda: None if r.random() < 0.05 else r.randrange(200)
    return [(i, key(), at()) for i in range(n)], [(key(), at(), i, i * 10) for i in range(n // 3)]


@pytest.mark.parametrize("n,keys,parts", [(400, 7, 9), (300, 1, 16), (60, 40, 3), (3, 2, 8)])
def test_asof_against_a_plain_loop(spark, n, keys, parts):
    left, right = drawn(n, keys, n)
    found = times.asof(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, tie int, v int"), "k", "t", ties="tie", spread="id", parts=parts)
    assert found.columns == ["id", "k", "t", "right_t", "right_tie", "right_v"]
    assert sorted((r.id, r.right_v) for r in found.collect()) == plain_asof(left, right)


def test_asof_carries_over_batches_and_whole_partitions(spark):
    """One right row of one key, then far more left rows than a batch or a partition holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = spark.range(500).select("id", F.lit("x").alias("k"), (F.col("id") + 5).alias("t"))
        found = times.asof(left, spark.createDataFrame([("x", 10, "v")], "k string, t long, part string"), "k", "t", spread="id", parts=12).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in found) == list(range(500))
    assert all(r.right_part == ("v" if r.t >= 10 else None) for r in found)


def test_asof_of_empty_tables_and_clashing_names(spark):
    left, right = spark.createDataFrame([(1, 5, "a")], "key int, end int, left string"), spark.createDataFrame([(1, 4, "b")], "key int, end int, right string")
    assert [tuple(r) for r in times.asof(left, right, "key", "end").collect()] == [(1, 5, "a", 4, "b")]
    assert [tuple(r) for r in times.asof(left, right.limit(0), "key", "end").collect()] == [(1, 5, "a", None, None)]
    assert times.asof(left.limit(0), right, "key", "end").collect() == []
    with pytest.raises(ValueError):
        times.asof(left, right, "key", "end", prefix="")


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_within_against_a_plain_loop(spark, width):
    r = random.Random(width)
    spans = [(i, None if i % 19 == 0 else i % 3, s := r.randrange(-300, 300), s + r.choice([-1, 0, 1, 7, 8, 9, 64, 500])) for i in range(120)] + [(120, 1, None, 4)]
    dots = [(j, j % 3, None if j % 17 == 0 else r.randrange(-400, 800)) for j in range(150)]
    found = times.within(spark.createDataFrame(spans, "id int, k int, a long, b long"), spark.createDataFrame(dots, "id int, k int, a long"), "k", "a", "b", "a", width)
    assert found.columns == ["id", "k", "a", "b", "point_id", "point_a"]
    want = sorted((i, j) for i, k, a, b in spans for j, k2, t in dots if None not in (k, a, t) and k == k2 and a <= t <= b)
    assert sorted((x.id, x.point_id) for x in found.collect()) == want


def test_long_intervals_send_no_more_rows(spark):
    """An interval stands in two cells at most, whatever its length."""
    spans = spark.createDataFrame([(1, 1, 3, 10**15)], "id int, k int, a long, b long")
    dots = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    found = times.within(spans, dots, "k", "a", "b", "t", 1)
    assert found.count() == 47
