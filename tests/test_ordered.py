"""Digest trees: independent of partitions, sensitive to order and to every value; changes named by block."""

import hashlib

import pytest
from pyspark.sql import functions as F

from planewise import records
from planewise.errors import CompatibilityError
from planewise.operators import ordered
from planewise.plans.bases import text_hash


def table(spark, n=700):
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("o"), "id").alias("object_id"), F.array(F.col("id") * 1.5).alias("vec"))


def plain(rows, size, fanout):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    entry = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    level = [digest("".join(entry(v) for v in r)) for r in rows]
    level = [digest("".join(level[i : i + size])) for i in range(0, len(level), size)]
    while len(level) > 1:
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return digest("".join(level))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 99, 401])
def test_root_against_a_plain_tree(spark, n):
    """Sizes at the edges of blocks and levels."""
    names = [None if i % 7 == 3 else f"ö{i}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(names)), "pos long, object_id string").repartition(5)
    assert ordered.root(ordered.blocks(df, ["object_id"], size=10), 3).first()[0] == plain(list(enumerate(names)), 10, 3)


def test_partitions_do_not_matter_but_order_does(spark):
    root = lambda df: ordered.root(ordered.blocks(df, ["object_id", "vec"], size=16), 4).first()[0]
    df = table(spark)
    assert root(df) == root(df.repartition(7, "object_id")) == root(df.coalesce(1))
    swapped = df.withColumn("pos", F.when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos")))
    assert root(swapped) != root(df)


def test_one_changed_row_is_named_by_its_block(spark):
    made = lambda df: ordered.blocks(df, ["object_id", "vec"], size=16)
    df = table(spark)
    other = df.withColumn("vec", F.when(F.col("pos") == 350, F.array(F.lit(None).cast("double"))).otherwise(F.col("vec")))
    assert [tuple(r) for r in ordered.changed(made(df), made(other)).collect()] == [(350 // 16, 16, 16)]
    assert ordered.changed(made(df), made(df.repartition(3))).collect() == []
    assert [tuple(r) for r in ordered.changed(made(df), made(df.where("pos < 690"))).collect()] == [(43, 12, 2)]
    lost = df.withColumn("pos", F.when(F.col("pos") != 0, F.col("pos")))
    assert sorted(tuple(r) for r in ordered.changed(made(df), made(lost)).collect()) == [(-1, None, 1), (0, 16, 15)]


def test_replay_of_new_and_old_records(spark):
    """Old records hold one running hash of the ids, which is still checked."""
    df, features = table(spark, 30), ["a"]
    now = records.hashes(df, features)
    assert set(now) == {"matrix", "id_tree", "features"}
    records.check_replay(records.InvestigationRecord("x", [], now), now, df)
    old = {"matrix": now["matrix"], "object_ids": text_hash(f"o{i}" for i in range(30)), "features": now["features"]}
    records.check_replay(records.InvestigationRecord("x", [], old), now, df)
    swapped = df.withColumn("pos", 29 - F.col("pos"))
    for held in (now, old):
        with pytest.raises(CompatibilityError):
            records.check_replay(records.InvestigationRecord("x", [], held), records.hashes(swapped, features), swapped)
