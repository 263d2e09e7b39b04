"""A tree of digests over rows in an order, so that two tables are told apart by one digest and their differences by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

BLOCK_ROWS = 1024
FANOUT = 256


def _entry(rows: DataFrame, c: str) -> Column:
    """A column as text with its length before it, ``-`` if null, so that no two rows read alike; arrays and structs as JSON."""
    nested = isinstance(rows.schema[c].dataType, (ArrayType, MapType, StructType))
    text = F.to_json(F.col(f"`{c}`"), {"ignoreNullFields": "false"}) if nested else F.col(f"`{c}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _together(digest: str, order: Sequence[str]) -> Column:
    """One digest of a group's digests in their order; groups hold ``BLOCK_ROWS`` rows or ``FANOUT`` digests."""
    held = F.array_sort(F.collect_list(F.struct(*order, digest)))
    return F.sha2(F.array_join(F.transform(held, lambda x: x[digest]), ""), 256)


def blocks(rows: DataFrame, columns: Sequence[str], order: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    """(block, n, digest): digests of the rows whose ``order``, a whole number from 0, lies in ``[block * size, (block + 1) * size)``.

    Where rows stand or how the table is partitioned doesn't matter, only their order's
    numbers.  Rows of one number stand in the order of their digests; rows without one
    form the block -1.
    """
    one = F.sha2(F.concat_ws("", *(_entry(rows, c) for c in [order, *columns])), 256)
    return rows.select(F.col(order).alias("_at"), F.coalesce(F.expr(f"`{order}` div {size}"), F.lit(-1)).alias("block"), one.alias("_digest")).groupBy("block").agg(F.count("*").alias("n"), _together("_digest", ["_at"]).alias("digest"))


def root(blocked: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(root): the digest over all blocks, ``fanout`` of them together at each level; no row reaches the driver, which asks for the number of the last block only.

    The root is the digest of what one digest remains (and of the block -1), an empty
    table's that of nothing.
    """
    last, level = blocked.agg(F.max("block")).first()[0] or 0, blocked.select("block", "digest")
    while last > 0:
        level = level.groupBy(F.expr(f"block div {fanout}").alias("_up")).agg(_together("digest", ["block"]).alias("digest")).withColumnRenamed("_up", "block")
        last //= fanout
    return level.agg(_together("digest", ["block"]).alias("root"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(block, n_before, n_after) of the blocks whose digests differ, or that only one table has (its other number is null)."""
    a, b = (t.select("block", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"_{s}")) for t, s in ((before, "before"), (after, "after")))
    return a.join(b, "block", "full").where(~F.col("_before").eqNullSafe(F.col("_after"))).select("block", "n_before", "n_after")
