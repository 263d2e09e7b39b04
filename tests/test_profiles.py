"""Cubes against plain counts; sketches within their rank error, merged or not."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from planewise.operators import profiles


def test_cube_against_plain_counts(spark):
    """A null class is a group of its own at every level; null values count but have no part in means."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice([None, 1.0, 2.0])) for _ in range(80)] + [(None, "z", None)]
    want = collections.defaultdict(list)
    for a, b, v in rows:
        for fa, fb in itertools.product((0, 1), (0, 1)):
            want[(None if fa else a, None if fb else b, 2 * fa + fb)].append(v)
    shape = lambda vs: (len(vs), round(sum(k) / len(k), 9) if (k := [v for v in vs if v is not None]) else None)
    found = profiles.cube(spark.createDataFrame(rows, "a string, b string, v double"), ["a", "b"], "v").collect()
    assert {(x.a, x.b, x.folded): (x.n, None if x["mean"] is None else round(x["mean"], 9)) for x in found} == {k: shape(v) for k, v in want.items()}
    assert len(found) == len(want)
    assert profiles.cube(spark.createDataFrame([], "a string, b string, v double"), ["a", "b"], "v").collect() == []


def test_sketches_keep_their_rank_error(spark):
    """One group holds nine tenths; values are skewed, tied, null and NaN; coarse sketches come from fine ones."""
    points = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("g"), F.when(F.col("id") % 7 == 0, 5.0).when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 > 0, F.exp(F.rand(7) * 9)).alias("v"))
    fine = profiles.sketches(points, ["g"], "v")
    ranks = [0.01, 0.25, 0.5, 0.9, 0.99]
    errors = profiles.rank_errors(points, profiles.quantiles(fine, ranks), ["g"], "v").collect()
    assert len(errors) == 4 * len(ranks) and max(e.error for e in errors) <= 0.01
    whole = profiles.rank_errors(points, profiles.quantiles(profiles.merged(fine), ranks), [], "v").collect()
    assert len(whole) == len(ranks) and max(e.error for e in whole) <= 0.01
    assert {e.n for e in whole} == {points.where("v IS NOT NULL AND NOT isnan(v)").count()}
    assert fine.select(F.max(F.length("sketch"))).first()[0] < 40_000


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert profiles.sketches(none, ["g"], "v").collect() == []
    assert profiles.merged(profiles.sketches(none, ["g"], "v")).collect() == []
