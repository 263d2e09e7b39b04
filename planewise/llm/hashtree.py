"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks in a region, shards in a rack.  A row
descends it: at each level every child draws ``-ln(u) / weight`` from a hash of the
row's key and the child's name, and the smallest draw wins.  A child's weight is the
sum of its shards' weights, so shards fill in proportion to weight.  When a weight
changes, draws of the other children keep their values: a row moves only into or out
of the subtree whose weight changed, and below an unchanged subtree nothing moves.

The ``key`` law holds: the key and the tree alone decide.  A tree grows by whole new
subtrees (``grown``): the added shard stands in a region of its own, so it takes rows
from all the others and none of them takes rows from another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import cut, gapless_rank

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3

#: The unit interval of a draw: 13 hexadecimal digits of MD5, exact in a double.
DRAW_RANGE = 16.0**13


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def regular_tree(shards: int) -> list[Leaf]:
    """``shards`` leaves of weight 1, filled rack by rack and region by region."""
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    return [Leaf(i, i // per_region, i % per_region // SHARDS_PER_RACK) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region."""
    return [*tree, Leaf(max(x.shard for x in tree) + 1, max(x.region for x in tree) + 1, 0, weight)]


def _argmin(children: list[tuple[str, float, str]], key: str, dialect: str) -> str:
    """SQL for the winner among (name, weight, result) by the smallest draw; ties go to the first."""
    if len(children) == 1:
        return children[0][2]

    def draw(name: str, weight: float) -> str:
        digest = f"substr(md5(concat({key}, '|{name}')), 1, 13)"
        number = f"CAST(conv({digest}, 16, 10) AS DOUBLE)" if dialect == "spark" else f"CAST(CAST('0x' || {digest} AS BIGINT) AS DOUBLE)"
        return f"(-ln(({number} + 1.0) / {DRAW_RANGE!r}D) / {weight!r}D)" if dialect == "spark" else f"(-ln(({number} + 1.0) / {DRAW_RANGE!r}) / {weight!r})"

    if dialect == "spark":
        draws = ", ".join(f"named_struct('d', {draw(n, w)}, 'i', {i})" for i, (n, w, _) in enumerate(children))
        won = f"array_min(array({draws})).i"
    else:
        draws = ", ".join(f"{{'d': {draw(n, w)}, 'i': {i}}}" for i, (n, w, _) in enumerate(children))
        won = f"list_min([{draws}]).i"
    if all(r.isdigit() for _, _, r in children) and [int(r) for _, _, r in children] == list(range(int(children[0][2]), int(children[0][2]) + len(children))):
        return f"({won} + {children[0][2]})"
    return f"CASE {won} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, _, r) in enumerate(children)) + " END"


def descent_sql(tree: list[Leaf], key: str, dialect: str = "spark") -> str:
    """SQL of the shard that ``key`` (SQL of a string) descends to; the other dialect is ``duckdb``."""

    def shards(region: int, rack: int) -> str:
        own = [x for x in tree if (x.region, x.rack) == (region, rack)]
        return _argmin([(f"s{x.shard}", x.weight, str(x.shard)) for x in own], key, dialect)

    def racks(region: int) -> str:
        own = sorted({x.rack for x in tree if x.region == region})
        weigh = lambda k: sum(x.weight for x in tree if (x.region, x.rack) == (region, k))
        return _argmin([(f"g{region}k{k}", weigh(k), shards(region, k)) for k in own], key, dialect)

    regions = sorted({x.region for x in tree})
    weigh = lambda g: sum(x.weight for x in tree if x.region == g)
    return _argmin([(f"g{g}", weigh(g), racks(g)) for g in regions], key, dialect)


def key_sql(dialect: str = "spark") -> str:
    return "coalesce(CAST(doc_id AS STRING), 'null')" if dialect == "spark" else "coalesce(CAST(doc_id AS VARCHAR), 'null')"


def place(docs: DataFrame, tree: list[Leaf], new_tree: list[Leaf] | None = None) -> DataFrame:
    """Shard, slot and shard after growth of every row of ``docs`` (doc_id, text).

    Returns doc_id, size (UTF-8 bytes of the text, null as none, plus 8), text_crc32,
    law (``key``), shard, slot (gapless from 0 within a shard, by doc_id) and
    grown_shard (null without ``new_tree``).  A null doc_id is a key like any other;
    repeated rows go to one shard and take slots of their own; an empty table gives no
    rows; further columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    ).select(
        "*",
        F.expr(descent_sql(tree, key_sql())).cast("int").alias("shard"),
        (F.expr(descent_sql(new_tree, key_sql())).cast("int") if new_tree else F.lit(None).cast("int")).alias("grown_shard"),
    )
    out = gapless_rank(cut(placed), "shard", "doc_id", "slot", ("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle(tree: list[Leaf], new_tree: list[Leaf]) -> str:
    """The same placement as DuckDB SQL, which has no CRC32: bytes are folded through the polynomial's table."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    fold = f"list_reduce(bytes, lambda c, x: xor(c >> 8, ([{', '.join(map(str, table))}])[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), 4294967295::BIGINT)"
    return f"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 AS n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM h),
p AS (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, CAST(xor({fold}, 4294967295::BIGINT) AS BIGINT) AS text_crc32, 'key' AS law, CAST({descent_sql(tree, key_sql('duckdb'), 'duckdb')} AS INTEGER) AS shard, CAST({descent_sql(new_tree, key_sql('duckdb'), 'duckdb')} AS INTEGER) AS grown_shard FROM b)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM p"""
