"""Belief worlds of any size, drawn in tasks from counter-based random numbers.

Row i of a population is drawn from block ``i // BLOCK`` of its own Philox stream, whose
key is (seed, name) and whose counter is the block's number.  So a row depends on the
seed, the population and i alone: not on partitions, retries or the number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import vectors
from planewise.shipping import ship
from planewise.sources import generators as g

BLOCK = 4096
Draw = Callable[[np.random.Generator, int], np.ndarray]


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def drawn(spark: SparkSession, name: str, n: int, seed: int, draw: Draw) -> DataFrame:
    """(i, vec): ``n`` rows of what ``draw(generator, BLOCK)`` gives for each block; every block is drawn whole and cut."""
    ship(spark)
    key = np.array([seed, zlib.crc32(name.encode())], np.uint64)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["b"]:
                rows = draw(np.random.Generator(np.random.Philox(key=key, counter=[0, 0, int(b), 0])), BLOCK)
                first = int(b) * BLOCK
                rows = rows[: n - first]
                yield pd.DataFrame({"i": np.arange(first, first + len(rows)), "vec": list(rows)})

    count = -(-n // BLOCK)
    return spark.range(0, count, 1, max(1, min(count, 16 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "b").mapInPandas(blocks, "i long, vec array<double>")


def dirichlet(spark: SparkSession, name: str, n: int, seed: int, alpha: Sequence[float]) -> DataFrame:
    """(i, vec): points of a Dirichlet distribution."""
    return drawn(spark, name, n, seed, lambda rng, rows: rng.dirichlet(alpha, rows))


def curve(spark: SparkSession, n: int, start: float, end: float, at: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(i, vec, t): ``at(t)`` for ``n`` even steps of ``t``, divided by its sum."""
    rows = _numbered(spark, n).withColumn("t", F.lit(start) + (end - start) * F.col("i") / max(n - 1, 1)).withColumn("vec", F.array(*at(F.col("t"))))
    whole = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("vec", F.transform("vec", lambda x: x / whole))


def together(parts: Sequence[tuple[str, DataFrame, int, Column]], prefix: str, width: int) -> DataFrame:
    """Populations (name, rows, count, label) one after the other: (object_id, pos, label, vec, generator_component)."""
    placed, before = [], 0
    for name, rows, n, label in parts:
        placed.append(rows.select((F.col("i") + before).alias("pos"), label.alias("label"), "vec", F.lit(name).alias("generator_component")))
        before += n
    number = F.col("pos").cast("string")
    number = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))  # wider ids aren't cut
    return reduce(DataFrame.unionByName, placed).select(F.concat(F.lit(f"{prefix}_"), number).alias("object_id"), "pos", "label", "vec", "generator_component")


def belief_world(spark: SparkSession, n_samples: int = 2000, seed: int = 20260801) -> DataFrame:
    """The populations of ``generators.belief_world`` with the same shares and classes, at any size; ids are wide enough for all."""
    count = lambda share: int(n_samples * share)
    parts: list[tuple[str, DataFrame, int, Column]] = []

    def add(name: str, n: int, alpha: Sequence[float], label: Column) -> None:
        parts.append((name, dirichlet(spark, name, n, seed, alpha), n, label))

    for c in range(g.CORNERS):
        add(f"confident_corner_{c}", count(g.CORNER_SHARE), [50.0 if k == c else 2.0 for k in range(g.CORNERS)], F.lit(f"class_{c}"))
    for name, alpha, c in g.BANDS:
        add(name, count(g.AMBIGUITY_SHARE), alpha, F.lit(f"class_{c}"))
    add("high_entropy_center", count(g.CENTRE_SHARE), [8.0] * g.CORNERS, F.lit("ambiguous"))
    n, little = count(g.BRIDGE_SHARE), F.lit(0.01)
    parts.append(("narrow_bridge_02", curve(spark, n, 0.1, 0.9, lambda t: (1 - t, little, t, little)), n, F.when(F.col("t") < 0.5, "class_0").otherwise("class_2")))
    n = count(g.WALK_SHARE)
    parts.append(("evidence_trajectory", curve(spark, n, 0.0, 1.0, lambda s: (0.25 * (1 - s), 0.25 + 0.75 * s, 0.25 * (1 - s), 0.25 * (1 - s))), n, F.lit("class_1")))
    names = [f"class_{k}" for k in range(g.CORNERS)]
    add("isolated_outlier", max(1, count(g.LONE_SHARE)), [0.2] * g.CORNERS, vectors.argmax_label(F.col("vec"), names))
    add("cluster_outlier", count(g.CLUSTER_SHARE), [1.0, 15.0, 15.0, 1.0], F.lit("class_1"))
    return together(parts, "synth", max(5, len(str(n_samples))))


def apparel_world(spark: SparkSession, n_samples: int = 200, seed: int = 42) -> DataFrame:
    """Ten classes of Gaussian logits through a softmax, families taken for each other, as ``generators.apparel_beliefs``."""
    parts, n = [], n_samples // 10
    for c in range(10):
        mean = g.apparel_mean(c)
        logits = drawn(spark, f"class_{c}", n, seed, lambda rng, rows, mean=mean: rng.normal(mean, g.APPAREL_SPREAD, (rows, 10)))
        parts.append((f"class_{c}", logits.withColumn("vec", vectors.softmax(F.col("vec"))), n, F.lit(f"class_{c}")))
    return together(parts, "fashion", max(4, len(str(n_samples))))
