"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewise.shipping import ship

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the checkpoint folder its context has.

    Where neither is set, a session on one machine (a test) gets a temporary folder; on
    a cluster executors would each write to a folder of their own, so that's an error.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="planewise-")
    if not held.isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Later jobs read these files, so a lost executor costs no recomputation of what came
    before.  Results are lazy and may be read long after, so the files stay until the
    session ends, like a checkpoint's; then they are removed.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"planewise-{uuid.uuid4().hex}")
    forget_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system when the session's process ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work in Python: over as many partitions as there are cores, if it has fewer (one small file)."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gapless_rank(df: DataFrame, key: str, order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a column; nulls come first, ``ties`` order equal values.

    A window over a group would put a hot group into one task.  Instead rows are dealt to
    partitions by ranges of (key, order, ties, place in the input), whose bounds Spark
    samples: so wide or uneven values, a hot group and a value that repeats without end
    all give even partitions.  Each partition is sorted and written with its rows'
    places; a prefix sum over the partitions' counts, one row for each key that a
    partition holds, gives each its start.
    """
    at = "__at"
    by = [F.col(key), F.col(order).asc_nulls_first(), *ties, at]
    dealt = df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    runs = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(key, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    # At most as many rows as partitions and keys together.
    return placed.join(F.broadcast(starts), [key, "__part"]).withColumn(name, (F.col(at) + F.col("__start")).cast("long")).drop(at, "__part", "__start")


def text_or_empty(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def parts(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes: Python's copies of texts are held for one part at a time."""
    for b in batches:
        rows = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_batch(df: DataFrame, schema: str | dict[str, tuple[str, pa.DataType]], make: Callable[[dict], dict]) -> DataFrame:
    """Arrow batches of ``df`` through ``make``: column values in, columns out.

    ``make`` gets a dict of Arrow arrays and returns a dict of Arrow arrays or lists.
    Arrow keeps 64-bit ids exact where some are null, which pandas would not.  The
    schema is DDL text of plain types or, by column, the type for Spark and for Arrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for b in parts(batches):
            out = make(dict(zip(b.schema.names, b.columns, strict=True)))
            to = to or (_arrow_schema(schema) if isinstance(schema, str) else pa.schema([(n, kind) for n, (_, kind) in schema.items()]))
            yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type) for f in to], schema=to)

    return df.mapInArrow(run, schema if isinstance(schema, str) else ", ".join(f"{n} {kind}" for n, (kind, _) in schema.items()))


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``chars`` characters, so that working arrays stay small."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
