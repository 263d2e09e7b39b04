"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, gone through as often as its target
may ask for.  A copy's virtual time is the words of its source up to it, divided by the
source's target: all queues are served in the proportion of their targets if copies are
taken in the order of that time.  A global sort by ranges of it finds the time at which
the budget is spent; what comes before is taken, whole.

A copy counts to its queue with the half of its own words: by the time of its last word
every source would end half a document short on average, by that of its first half a
document over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.llm.common import cut, gapless_rank

#: Weights of the sources in their order, again and again; share of all words; times a source may be gone through.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
#: Sources up to which their table (some tens of bytes a row) is broadcast; it is counted.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Number of words: each becomes one letter and what isn't one goes, so that no list of words is held."""
    return F.char_length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = EPOCHS) -> DataFrame:
    """(grp, source_size, target) of written sources (grp, source_size); groups sort as the sources do.

    Every source has its weight's part of the budget, up to ``most`` times its size; what
    is over goes to the others by weight.  A round shares by one factor and finds who is
    full; only three sums reach the driver.
    """
    ordered = gapless_rank(sizes.withColumn("all", F.lit("")), "all", "grp", "pos")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights)).cast("int") + 1).cast("double")
    held = cut(ordered.select("grp", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    budget = (held.agg(F.sum("source_size")).first()[0] or 0) * share
    factor, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(factor) >= F.col("cap")
        s = held.agg(F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, F.col("cap"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if s["full"] == full or not s["open"]:
            break
        full, factor = s["full"], (budget - (s["used"] or 0.0)) / s["open"]
    return held.select("grp", "source_size", F.least("cap", F.col("weight") * F.lit(factor)).alias("target"))


def _spent(copies: DataFrame, budget: float) -> float | None:
    """The virtual time of the last copy of which the larger part lies within the budget, by a sort over ranges of time."""
    by = ["time", "size"]
    dealt = cut(copies.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("size").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))  # one row a partition
    last = starts.where(F.col("start") < budget).orderBy(F.desc("part")).first()
    if last is None:
        return None
    rows = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.where(F.col("part") == last["part"]).select("time", "size", (F.sum("size").over(rows) + last["start"]).alias("upto"))
    within = own.where(F.col("upto") - F.col("size") / 2.0 <= budget).agg(F.max("time")).first()[0]
    return within if within is not None else dealt.where(F.col("part") < last["part"]).agg(F.max("time")).first()[0]


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, source, text).

    ``taken`` are the words of all copies that the mix takes.  A null source is one like
    any other and comes last; a null text has no words; documents without words are never
    taken; a null doc_id has its own place in the shuffle.  The shuffle is a hash of seed
    and doc_id; rows that share it stand by size, so a rerun gives the same rows whatever
    the partitions.  Documents are taken whole, however long.  An empty table gives no
    rows.  Further columns aren't read.
    """
    group = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))  # a null source comes last
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("grp"), words(F.col("text")).alias("size"), key.alias("key")))
    by = ["grp", "key", "size"]
    queued = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = queued.groupBy("grp", "part").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a partition
    starts = held.select("grp", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    shares = cut(targets(cut(held.groupBy("grp").agg(F.sum("sum").alias("source_size")))))
    placed = starts.join(shares, "grp")
    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    upto = Window.partitionBy("grp", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a part of a partition
    served = queued.withColumn("own", F.sum("size").over(upto) - F.col("size") / 2.0).join(F.broadcast(placed) if few else placed, ["grp", "part"])
    time = lambda epoch: F.try_divide(F.col("own") + F.col("start") + epoch * F.col("source_size"), F.col("target"))
    timed = cut(served.select("doc_id", "size", "source_size", "target", F.array(*map(time, range(EPOCHS))).alias("times")))
    budget = shares.agg(F.sum("target")).first()[0] or 0.0
    end = _spent(timed.where(F.col("size") > 0).select("size", F.explode("times").alias("time")).where(F.col("time").isNotNull()), budget)
    copies = F.size(F.filter("times", lambda t: t <= F.lit(end))) if end is not None else F.lit(0)
    return timed.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * copies).otherwise(0).cast("long").alias("taken"))


def oracle(seed: str = SEED) -> str:
    """The same as DuckDB SQL; targets by the closed form over sources in the order in which they fill."""
    weight = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(WEIGHTS))
    return f"""WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS grp, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT grp, CAST(sum(size) AS BIGINT) AS source_size, {float(EPOCHS)} * sum(size) AS cap, CASE (row_number() OVER (ORDER BY grp) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM d GROUP BY grp),
o AS (SELECT *, (SELECT sum(source_size) FROM s) * {SHARE} AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(weight) OVER (ORDER BY cap / weight DESC, grp DESC) AS open FROM s),
f AS (SELECT coalesce(first((budget - used) / open ORDER BY cap / weight, grp) FILTER (WHERE (budget - used) / open <= cap / weight), max(cap / weight)) AS factor FROM o),
t AS (SELECT grp, source_size, least(cap, weight * factor) AS target FROM s, f),
q AS (SELECT doc_id, size, grp, sum(size) OVER (PARTITION BY grp ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS own FROM d),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN target > 0 THEN (own + e * source_size) / target END AS time FROM q JOIN t USING (grp), unnest(range(0, {EPOCHS})) AS u(e)),
g AS (SELECT time, sum(size) OVER (ORDER BY time, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS upto FROM c WHERE size > 0 AND time IS NOT NULL),
z AS (SELECT max(time) AS last FROM g WHERE upto <= (SELECT sum(target) FROM t))
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(CASE WHEN size > 0 AND time <= last THEN size ELSE 0 END) AS BIGINT) AS taken FROM c, z GROUP BY doc_id"""
