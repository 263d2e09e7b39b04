"""Table functions in SQL against the column builders and brute force."""

from dataclasses import replace

import numpy as np
import pytest

from planewise.functions import tables, vectors
from planewise.functions.metrics import REGISTRY
from planewise.operators.neighbors import knn
from planewise.operators.pairs import pairs, space
from planewise.sources import fixtures
from pyspark.sql import functions as F

K = 3


@pytest.fixture(scope="module")
def world(spark):
    tables.register(spark)
    points = fixtures.calibration(spark).select("object_id", "vec")
    points.union(spark.createDataFrame([("none", None), (None, [0.1, 0.2, 0.7])], points.schema)).createOrReplaceTempView("world")
    return points


@pytest.mark.parametrize(("name", "column"), [("sqrt_probability", vectors.sqrt_probability), ("clr_probability", vectors.clr), ("logit", vectors.logit)])
def test_represent(spark, world, name, column):
    got = {r["object_id"]: r["vec"] for r in spark.sql(f"SELECT * FROM represent(TABLE(world), '{name}')").collect()}
    want = {r["object_id"]: r["v"] for r in world.select("object_id", column(F.col("vec")).alias("v")).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_project(spark, world):
    got = {r["object_id"]: (r["x"], r["y"]) for r in spark.sql("SELECT * FROM project(TABLE(world), array(array(1D, 0D), array(0D, 0D), array(0D, 2D)))").collect()}
    assert got == {r["object_id"]: pytest.approx((r["vec"][0], 2 * r["vec"][2])) for r in world.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "hellinger", "fisher_rao", "aitchison", "jensen_shannon"])
@pytest.mark.parametrize("sides", [1, 4])
def test_neighbours(spark, world, metric, sides):
    rows = spark.sql(f"""WITH d AS (SELECT * FROM dealt(TABLE(world), {sides})), n AS (SELECT * FROM neighbours(TABLE(d) PARTITION BY (a, b), {K}, '{metric}'))
        SELECT src_id, neighbor_id, row_number() OVER (PARTITION BY src_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM n""").where(f"rank <= {K}").collect()
    want = knn(pairs(space(world, "vec", 3, REGISTRY.get(metric))), K).collect()
    assert sorted((r["src_id"], r["rank"], r["neighbor_id"]) for r in rows) == sorted((r["src_id"], r["rank"], r["neighbor_id"]) for r in want)


def test_neighbours_measure_few_pairs():
    """Keys rule pairs out; all 480,000 were measured before."""
    measured, m = [], REGISTRY.get("aitchison")
    counting = replace(m, block=lambda a, b: measured.append(np.broadcast(a[0], b[0]).size) or m.block(a, b))
    points, calls = np.random.default_rng(3).dirichlet(np.ones(5), 1600).tolist(), {}
    for name, metric in (("keyed", counting), ("plain", replace(m, key=None))):
        call = calls[name] = tables.neighbours_of({"aitchison": metric})()
        for n, vec in enumerate(points):
            for lefts in (False, True)[: 1 + (n < 300)]:
                call.eval({"object_id": f"p{n:05d}", "vec": vec, "lefts": lefts}, K, "aitchison")
    assert sorted(calls["keyed"].terminate()) == sorted(calls["plain"].terminate())
    assert sum(measured) < 100_000
