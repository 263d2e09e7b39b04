"""Folders of SQLite shards: round trips, ranges, commits, failures and changed bytes."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.sources import sqlite_bundle as sb


def edges(spark, first, end, parts=6):
    return spark.range(first, end, 1, parts).select((F.col("id") / 2.0).alias("distance"), F.lit("probability").alias("rep_id"), F.lit("euclidean").alias("metric_id"), F.concat(F.lit("o"), F.col("id")).alias("src_id"), F.concat(F.lit("o"), F.col("id") + 1).alias("neighbor_id"), F.lit(1).cast("long").alias("rank"))


def files(path):
    return sorted(os.listdir(path)) if os.path.exists(path) else []


def test_many_rows_by_tasks_and_back_by_ranges(spark, tmp_path):
    """300,000 rows: a shard a task, read in more partitions than shards; filters reach SQLite."""
    folder = sb.SQLiteBundleFolder(spark, str(tmp_path / "b"))
    folder.write("knn_edges", edges(spark, 0, 300_000))
    listed = sb.committed(folder.path, "knn_edges")
    assert len(listed) == 6 and sum(f["n"] for f in listed) == 300_000
    assert files(folder.path) == sorted([f["file"] for f in listed] + ["knn_edges.json"])
    back = spark.read.format("sqlite_bundle").option("table", "knn_edges").option("range_rows", 20_000).load(folder.path)
    assert back.rdd.getNumPartitions() >= 15
    assert back.agg(F.count("*"), F.countDistinct("src_id"), F.sum("distance")).first()[:] == (300_000, 300_000, 299_999 * 300_000 / 4)
    assert [r["neighbor_id"] for r in back.where("src_id = 'o77'").collect()] == ["o78"]
    assert folder.changed_shards().collect() == []


def test_vectors_keep_every_bit(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(50, 3)).tolist(), [float("nan"), float("inf"), -0.0], []]
    points = spark.createDataFrame([(f"o{i}", i, v) for i, v in enumerate(vectors)], "object_id string, pos long, vec array<double>").repartition(4)
    folder = sb.SQLiteBundleFolder(spark, str(tmp_path / "b"))
    folder.add_representation("r", points)
    folder.add_representation("s", points.limit(3))
    found = {r.object_id: np.array(r.vec, float).tobytes() for r in folder.points("r").collect()}
    assert found == {f"o{i}": np.array(v, float).tobytes() for i, v in enumerate(vectors)}
    assert folder.points("s").count() == 3


def seen(folder):
    """What isn't hidden; a task that outlives its failed job may leave a hidden file, for the sweep."""
    return [f for f in files(folder.path) if not f.startswith(".")]


def test_a_failed_job_leaves_the_table_as_it_was(spark, tmp_path):
    """One task of six fails, at its end; nothing of the job stays, with or without rows before."""
    folder = sb.SQLiteBundleFolder(spark, str(tmp_path / "b"))
    bad = edges(spark, 1000, 7000).withColumn("rank", F.when(F.col("src_id") == "o6999", F.raise_error(F.lit("lost"))).otherwise(F.col("rank")))
    with pytest.raises(Exception, match="lost"):
        folder.write("knn_edges", bad)
    assert seen(folder) == [] and folder.table("knn_edges").collect() == []
    folder.write("knn_edges", edges(spark, 0, 100))
    before = seen(folder)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            folder.write("knn_edges", bad, mode)
        assert seen(folder) == before and folder.table("knn_edges").count() == 100
    time.sleep(2)  # tasks that outlive their job
    folder.sweep()
    assert files(folder.path) == before and folder.table("knn_edges").count() == 100 and folder.sweep() == 0


def test_append_overwrite_and_repeated_keys(spark, tmp_path):
    folder = sb.SQLiteBundleFolder(spark, str(tmp_path / "b"))
    folder.write("knn_edges", edges(spark, 0, 10))
    folder.write("knn_edges", edges(spark, 10, 15))
    assert folder.table("knn_edges").count() == 15
    folder.write("knn_edges", edges(spark, 20, 22), "overwrite")
    assert sorted(r.src_id for r in folder.table("knn_edges").collect()) == ["o20", "o21"]
    assert len(files(folder.path)) == 3  # empty tasks leave no file
    with pytest.raises(Exception, match="UNIQUE"):
        folder.write("knn_edges", edges(spark, 5, 6).unionByName(edges(spark, 5, 6)).coalesce(1))
    with pytest.raises(Exception, match="columns"):
        folder.write("knn_edges", edges(spark, 0, 1).drop("rank"))


def test_changed_bytes_are_named(spark, tmp_path):
    folder = sb.SQLiteBundleFolder(spark, str(tmp_path / "b"))
    folder.write("knn_edges", edges(spark, 0, 600, 3))
    one, two, _ = (os.path.join(folder.path, f["file"]) for f in sb.committed(folder.path, "knn_edges"))
    with open(one, "r+b") as f:
        f.seek(-1, 2)
        f.write(b"x")
    os.remove(two)
    assert sorted(tuple(r) for r in folder.changed_shards().collect()) == sorted([("knn_edges", one), ("knn_edges", two)])
