"""Streams of sessions and of drift give the rows of a table, over late rows and a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from planewise.streaming import composition

KINDS = ("a", "b", "c")
SCHEMA = "ts timestamp, user_id long, event_type string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def rows(hours, shift=0.0):
    start = datetime.datetime(2024, 1, 1)
    return [(start + datetime.timedelta(hours=h + shift + u / 100), u, KINDS[(int(h * 3) + u) % (2 + u % 2)]) for h in hours for u in range(4)]


def run(stream, tmp_path, out):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}_state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def put(spark, tmp_path, name, what):
    spark.createDataFrame(what, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def shaped(df):
    return sorted((str(r.window_start), r.object_id, r.n, r.n_before, None if r.drift is None else round(r.drift, 9)) for r in df.collect())


def test_drift_of_a_stream_with_late_rows_and_a_restart(rocks, tmp_path):
    """Three runs of one checkpoint: the second brings rows late but in time and rows too late, the third closes all windows."""
    spark, shares = rocks, lambda df: composition.drift(composition.compositions(df, KINDS, window="1 hour", late="2 hours"), 3)
    early, intime, late, last = rows([0.1, 0.5, 1.2, 2.7, 3.3, 9.1]), rows([8.4, 10.2, 14.9]), rows([1.7, 3.9], 0.05), rows([16.1, 30.5])
    put(spark, tmp_path, "in", early)
    stream = shares(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    run(stream, tmp_path, "out")
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert before > 0
    put(spark, tmp_path, "in", intime + late)
    run(stream, tmp_path, "out")
    put(spark, tmp_path, "in", last)
    run(stream, tmp_path, "out")
    want = shares(spark.createDataFrame(early + intime + last, SCHEMA)).where(F.col("window_start") < F.lit("2024-01-02 03:00:00").cast("timestamp"))
    found = shaped(spark.read.parquet(str(tmp_path / "out")))
    assert found == shaped(want) and len(found) > before


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """A late row joins two sessions into one; rows without key or time don't count."""
    first, second = rows([0.0, 1.0, 5.0, 9.0]), rows([3.0, 11.5, 40.0])
    put(spark, tmp_path, "in", [*first, (None, 1, "a"), (first[0][0], None, "a")])
    made = lambda df: composition.sessions(df, KINDS, "2 hours 30 minutes", late="12 hours")
    stream = made(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    run(stream, tmp_path, "out")
    put(spark, tmp_path, "in", second)
    run(stream, tmp_path, "out")
    shape = lambda df: sorted((str(r.window_start), r.object_id, r.n, tuple(r.vec)) for r in df.where("window_start < '2024-01-02'").collect())
    found = shape(spark.read.parquet(str(tmp_path / "out")))
    assert found == shape(made(spark.createDataFrame(first + second, SCHEMA)))
    assert len(found) == 8 and {r[2] for r in found} == {4, 2}


def test_sliding_windows_overlap(spark):
    found = composition.compositions(spark.createDataFrame(rows([0.5]), SCHEMA), KINDS, window="1 hour", slide="15 minutes")
    assert found.groupBy("object_id").count().agg(F.min("count"), F.max("count")).first()[:] == (4, 4)


def test_drift_of_a_table(spark):
    """First window of a key: null; equal shares: 0; disjoint ones: 1; an empty table: no rows."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([(at(0), 1, "a"), (at(1), 1, "a"), (at(2), 1, "b"), (at(3), 1, "x"), (at(3), 2, "c")], SCHEMA)
    made = lambda df: composition.drift(composition.compositions(df, KINDS), 3)
    assert [(r[1], r[2], r[3], r[4]) for r in shaped(made(events))] == [("1", 1, 0, None), ("1", 1, 1, 0.0), ("1", 1, 2, 1.0), ("2", 1, 0, None)]
    assert made(events.limit(0)).collect() == []
